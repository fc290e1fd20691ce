"""An append-only spool of events and streams that replay it with state, list by list, and timers.

append() adds files to the spool; nothing in it is changed. A replay takes what is there (availableNow), stops, and goes on from its
checkpoint when it is started again. capped() is operators.blocks.Cap as a stream: the times that count are a list in the state of
their key; a timer in event time clears the list when the last of them can't matter any more, so keys that went silent hold nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append(rows: DataFrame, spool: str) -> None:
    """Add rows to the spool as JSON lines."""
    rows.write.mode("append").json(spool)


def _processor(cap: int, span: int) -> StatefulProcessor:
    """A processor of a class of its own, so that it travels whole to the processes that run it."""

    class Capped(StatefulProcessor):
        """Rows that count: fewer than cap of the key's rows counted within the last span seconds."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.times = handle.getListState("times", "at long")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            frame = pd.concat(list(rows)).sort_values(["seconds", "row"])
            times, kept = [t[0] for t in self.times.get()], []
            for place, at in enumerate(frame["seconds"].tolist()):
                if len(times) < cap or at - times[-cap] >= span:
                    times.append(int(at))
                    kept.append(place)
            if kept:
                for due in self.handle.listTimers():
                    self.handle.deleteTimer(due)
                self.times.put([(t,) for t in times[-cap:]])
                self.handle.registerTimer((times[-1] + span) * 1000)
                yield frame.iloc[kept][["key", "row", "seconds"]]

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            self.times.clear()
            return iter([])

        def close(self) -> None:
            pass

    return Capped()


def capped(stream: DataFrame, key: str, row: str, seconds: str, cap: int, span: int, late: str = "1 hour") -> DataFrame:
    """key, row and seconds of the stream's rows that count. seconds: whole, in event time; rows later than late are dropped.

    Rows of a micro-batch are taken in order, so the batches should be: a spool that is appended to in time is.
    """
    at = F.timestamp_seconds(F.col(seconds))
    rows = stream.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(seconds).cast("long").alias("seconds"), at.alias("at")).withWatermark("at", late)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{n} {kinds[n]}" for n in ("key", "row", "seconds"))
    return rows.groupBy("key").transformWithStateInPandas(_processor(cap, span), schema, "append", "EventTime")


@contextmanager
def state_in_files(spark: SparkSession) -> Iterator[None]:
    """Within it, streams keep their state in RocksDB, which lists and timers need."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def replay(out: DataFrame, target: str, checkpoint: str) -> None:
    """Write what a stream makes of all that its source holds by now, and stop."""
    with state_in_files(out.sparkSession):
        query = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
