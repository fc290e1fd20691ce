"""Reading and writing: tables, id ranges, weight-balanced partitions, bounded batches of JSON lines, upserts."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


MOST_PER_REQUEST = 50
_SHARED: list[tuple] = []  # context and path of what this process wrote


def read_events_json(
    spark: SparkSession, path: str, schema: StructType | str, kinds: list[str], request: str | None = None,
    order: str | None = None
) -> DataFrame:
    """JSON lines of events: those of known kinds, with the time spent clamped to an hour and the share read to 0..100.

    Lines that are no JSON have no kind and are left out. With the columns of a request and of an order within it, a request
    counts for its first MOST_PER_REQUEST events, as the ingest that is modelled takes no more.
    """
    rows = spark.read.schema(schema).json(path)
    if request and order:
        place = F.row_number().over(Window.partitionBy(request).orderBy(order))
        rows = rows.withColumn("_place", place).filter(F.col("_place") <= MOST_PER_REQUEST).drop("_place")
    clamp = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(most)).alias(c)
    keep = [clamp("dwell_ms", 3_600_000) if c == "dwell_ms" else clamp("read_pct", 100) if c == "read_pct" else F.col(c) for c in rows.columns]
    return rows.filter(F.col("event_type").isin(kinds)).select(*keep)


def after(rows: DataFrame, key: str, cursor: int | None, limit: int | None = None) -> DataFrame:
    """Rows beyond a cursor, in order of the key; with a limit, a page of them. A page is a top-k, not a sort of all."""
    out = rows if cursor is None else rows.filter(F.col(key) > cursor)
    return out if limit is None else out.orderBy(key).limit(limit)


def balanced(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """Adds part: ranges of the key (a number) with about equally many rows; no key is in two parts.

    Bounds are percentiles of the key by a sketch, which combines before the shuffle: at most parts numbers. A part holds
    more than its share by the rows of one key and the sketch's error (a millionth of the rows) at most.
    """
    shares = [(i + 1) / parts for i in range(parts - 1)]
    bounds = rows.agg(F.percentile_approx(key, shares, 1_000_000)).first()[0] if shares else []
    part = F.lit(0)
    for bound in bounds or []:
        part = part + F.when(F.col(key) > F.lit(bound), 1).otherwise(0)
    return rows.withColumn("part", part)


def id_ranges(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """Ranges (a, b] that together are (low, high], of about equal width; at most parts of them, none empty."""
    edges = [low + (high - low) * i // parts for i in range(parts + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def shards(rows: DataFrame, key: str, n: int, cursors: dict[int, int] | None = None) -> DataFrame:
    """Adds shard, the key's remainder by n; of a shard with a cursor the rows beyond it."""
    out = rows.withColumn("shard", F.pmod(F.col(key), F.lit(n)).cast("int"))
    for shard, cursor in (cursors or {}).items():
        out = out.filter((F.col("shard") != shard) | (F.col(key) > cursor))
    return out


def read_sqlite(spark: SparkSession, path: str, name: str, key: str, schema: StructType, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that every executor can open, read-only, in ranges of an integer key that are read side by side.

    The bounds are the least and greatest key; each task opens the file for itself and streams its range.
    """
    columns = ", ".join(f'"{f.name}"' for f in schema.fields)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        low, high = con.execute(f'SELECT min("{key}"), max("{key}") FROM "{name}"').fetchone()
    found = id_ranges(low - 1, high, parts) if low is not None else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
                con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                con.execute("PRAGMA query_only = 1")
                yield from pd.read_sql_query(f'SELECT {columns} FROM "{name}" WHERE "{key}" > ? AND "{key}" <= ?', con, params=(a, b), chunksize=10_000)
                con.close()

    ranges = spark.createDataFrame(found, "a long, b long").repartition(max(1, len(found)), "a")
    return ranges.mapInPandas(run, schema)


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The objects of JSON documents that go over several lines: one object, or a list of them, a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_batches(rows: DataFrame, order: str, most_bytes: int, most_rows: int) -> DataFrame:
    """lines, n, bytes, last: rows as JSON lines in batches bounded by bytes and by rows, cut within each partition.

    A batch is as full as its bounds allow, but for the last of its partition. A row larger than most_bytes is a batch of
    its own. Rows are streamed; a task holds one batch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            out = []
            for line in frame["line"]:
                n = len(line.encode()) + 1
                if held and (size + n > most_bytes or len(held) >= most_rows):
                    out.append(("\n".join(held), len(held), size, False))
                    held, size = [], 0
                held.append(line)
                size += n
            yield pd.DataFrame(out, columns=["lines", "n", "bytes", "last"])
        if held:
            yield pd.DataFrame([("\n".join(held), len(held), size, True)], columns=["lines", "n", "bytes", "last"])

    lines = rows.sortWithinPartitions(order).select(F.to_json(F.struct(*rows.columns)).alias("line"))
    return lines.mapInPandas(run, "lines string, n long, bytes long, last boolean")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all machines share, as the cluster names it in spark.checkpoint.dir.

    Where none is set, a temporary folder will do if Spark runs in one machine; elsewhere that is an error. What is written to
    the path goes when the driver's process ends, or discard_shared() is called.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(folder)
    base = folder if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", folder) else f"file://{os.path.abspath(folder)}"
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    if not _SHARED:
        atexit.register(discard_shared)
    _SHARED.append((spark.sparkContext, path))
    return path


def discard_shared() -> None:
    """Delete what this process wrote to its shared paths, where their Spark context still runs; for the end of a job."""
    while _SHARED:
        context, path = _SHARED.pop()
        if context._jsc is None:
            continue
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already at the end of the process
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def file_marks(df: DataFrame) -> tuple:
    """Name, length and time of the files that df is read from: what is derived from them alone holds as long as these do."""
    context, out = df.sparkSession.sparkContext, []
    for name in sorted(df.inputFiles()):
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def materialised(df: DataFrame, label: str) -> DataFrame:
    """An intermediate written to the shared folder and read back, for results that are used more than once."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rebuilt(df: DataFrame, label: str, folder: str | None = None) -> str:
    """Write df in place of all that its folder held; the folder is new unless given. df must not be read from it."""
    folder = folder or shared_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(folder)
    return folder


def exported(df: DataFrame, label: str, rows_per_file: int) -> str:
    """JSON lines in files of at most so many rows; returns their folder."""
    path = shared_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", rows_per_file).json(path)
    return path


def upserted(base: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The state after an upsert: for each key the row of the greatest version; of equal ones the new row."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct(version, "_new", *(c for c in rest if c != version))).alias("x"))
    return best.select(*keys, *(F.col("x")[c].alias(c) for c in rest)).select(*base.columns)


def inserted(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The state after an insert that ignores keys that are there; of new rows that share a key the least stays."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, *(F.col("x")[c].alias(c) for c in rest))
    return base.unionByName(once.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def patched(base: DataFrame, partial: DataFrame, keys: list[str]) -> DataFrame:
    """The state after a partial update: columns that partial has replace those of base where they aren't null."""
    changed = [c for c in partial.columns if c not in keys]
    both = base.join(partial.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in changed)), keys, "left")
    return both.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns))
