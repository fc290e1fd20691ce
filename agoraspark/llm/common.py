"""What the operators of this folder share: tables, the shared folder, splits, labelled samples."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.shipping import ship_package

TEXTS_PER_BATCH = 1024
_BATCH_ROWS, _SPARKS_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"  # and what Spark takes where nothing is set
NO_ID = -(1 << 63)  # stands for a null doc_id in keys
_STORED: list[tuple] = []  # context and path of what this process wrote
_TOOLS: list = []  # caches of worker_tool


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied parquet tables, by any path that Spark can read."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Have so many rows in an Arrow batch that whole texts, which pass the JVM and Python in several copies, stay small beside the rest.

    A session's own value stays.
    """
    if spark.conf.get(_BATCH_ROWS) == _SPARKS_ROWS:
        spark.conf.set(_BATCH_ROWS, TEXTS_PER_BATCH)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the cluster names it in spark.checkpoint.dir.

    Where nothing is set a temporary folder is made and set, but only if Spark runs in one machine (a local master, as in
    tests); elsewhere executors wouldn't see it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", folder) else f"file://{os.path.abspath(folder)}"


def own_folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared one, which goes when the driver's process ends (or discard_stored is called)."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _STORED:
        atexit.register(discard_stored)
    _STORED.append((spark.sparkContext, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    What is returned is read lazily, so the files stay until the driver's process ends (or discard_stored is called).
    """
    spark = df.sparkSession
    path = own_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_stored() -> None:
    """Delete the tables that stored() wrote in this process, where their Spark context still runs.

    Results that were read from them can't be computed any more, so this is for the end of a job.
    """
    while _STORED:
        context, path = _STORED.pop()
        if context._jsc is None:
            continue
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already at the end of the process
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def crc_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null id counts as an empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % F.lit(folds)


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    """What tells rows apart: doc_id (NO_ID for none) and a hash of the text (that of an empty one for none)."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def unit_hash(*columns: Column | str) -> Column:
    """A value in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def class_share(rows: DataFrame, label: str, key: str | list[str], per_class: int) -> Column:
    """Whether a row is in a sample of per_class rows of each label value in expectation, by a hash of key (one or more columns).

    All rows are counted, and each class gets a share of its own, so the bound is the same at every size; classes below it
    are kept whole. Rows that repeat a key are in or out together: what repeats must be counted once by the caller.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    return unit_hash(F.lit("sample"), *([key] if isinstance(key, str) else key)) < share


def class_sample(rows: DataFrame, label: str, key: str | list[str], per_class: int) -> DataFrame:
    """The rows that class_share chooses."""
    return rows.filter(class_share(rows, label, key, per_class))


def unclashing(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as keep it apart from the columns of df (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def worker_tool(make: Callable) -> Callable:
    """Keep what make last returned (a vocabulary, an automaton) between the batches and tasks of a Python worker.

    Spark hands the workers of one stage on to the next, so work of another kind begins with drop_tools().
    """
    kept = lru_cache(1)(make)
    _TOOLS.append(kept)
    return kept


def drop_tools() -> None:
    """Free what worker_tool keeps in this process."""
    if any(kept.cache_info().currsize for kept in _TOOLS):
        for kept in _TOOLS:
            kept.cache_clear()
        gc.collect()
