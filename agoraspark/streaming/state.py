"""Stateful streams, each with a batch form that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def anchored_views(stream: DataFrame, key: str, ts: str, order: str, seconds: int = 900) -> DataFrame:
    """Views of a stream that count: the last one of the key that counted is `seconds` old or older.

    State is one time per key and ends after as much event time without a view. Rows of one micro-batch are taken in
    order; a row that comes later than the watermark is dropped by Spark. Returns key, order column and time.
    """
    rows = stream.withWatermark(ts, f"{seconds} seconds").select(F.col(key).alias("key"), F.col(order).alias("row"), F.col(ts).alias("at"))

    def step(_: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(frames)).sort_values(["at", "row"])
        kept = []
        for i, at in enumerate(frame["at"].astype("int64") // 1000):
            if last is None or at - last >= seconds * 1_000_000:
                last = at
                kept.append(i)
        state.update((int(last),))
        due = int(last) // 1000 + seconds * 1000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield frame.iloc[kept][["key", "row", "at"]]

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join(f"{n} {fields[n]}" for n in ("key", "row", "at"))
    return rows.groupBy("key").applyInPandasWithState(step, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, ts: str, kind: str, size: str, late: str) -> DataFrame:
    """Counts per window and kind; rows later than `late` behind the newest are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def collapsed(queue: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """What is due for each object of an outbox: its last action by sequence, so that an upsert after a delete counts."""
    rest = [c for c in queue.columns if c not in keys]
    last = queue.groupBy(*keys).agg(F.max(F.struct(sequence, *(c for c in rest if c != sequence))).alias("x"))
    return last.select(*keys, *(F.col("x")[c].alias(c) for c in rest))


def applied(state: DataFrame, queue: DataFrame, keys: list[str], sequence: str, action: str = "action") -> DataFrame:
    """The state after an outbox: deletes take rows away, upserts bring them; the rest of the state stays."""
    due = collapsed(queue, keys, sequence)
    return state.join(due.select(*keys), keys, "left_anti").unionByName(due.filter(F.col(action) == "upsert").select(*state.columns))


def expanded(queue: DataFrame, members: DataFrame, item: str, sequence: str) -> DataFrame:
    """item, sequence and action of a queue (kind, id, sequence, action) in which an entry of kind group stands for all its members.

    members: id and item. Of the entries of a group the last one alone counts, so it is expanded once.
    """
    groups = queue.filter("kind = 'group'").groupBy("id").agg(F.max(F.struct(sequence, "action")).alias("x")).select("id", f"x.{sequence}", "x.action")
    single = queue.filter("kind = 'item'").select(F.col("id").alias(item), sequence, "action")
    return single.unionByName(groups.join(members, "id").select(item, sequence, "action"))


def retry_at(queue: DataFrame) -> DataFrame:
    """Adds available_at: now plus two to the power of the attempts (8 at most) seconds, 300 at most."""
    wait = F.least(F.lit(300), F.pow(F.lit(2), F.least("attempts", F.lit(8)))).cast("int")
    return queue.withColumn("available_at", F.timestamp_add("SECOND", wait, F.col("failed_at")))


def drain(stream: DataFrame, target: str, keys: list[str], sequence: str, checkpoint: str):
    """A query that writes each micro-batch of an outbox, collapsed, to a folder of its own; replays overwrite it.

    Once a batch is written its sequence numbers are marked as sent, in a folder of marks beside the target; what has no mark
    wasn't forwarded. A batch that fails between the two is written again, so forwarding is at least once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        collapsed(batch, keys, sequence).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        batch.select(sequence).withColumn("sent_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{target}-sent/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
