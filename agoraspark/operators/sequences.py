"""Per-key sequences whose steps depend on which earlier rows counted, and streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agoraspark.operators.blocks import Cap, Gap, sequences


def accepted_rows(
    rows: DataFrame, keys: list[str], seconds: str, order: str, gap: int | None = None, cap: int | None = None, span: int | None = None
) -> DataFrame:
    """Adds accepted: whether a row counts, given the rows of its key that counted before it.

    gap: a row counts if the last row that did is at least so many seconds older. cap and span: a row counts if fewer
    than cap rows counted within the last span seconds. Rows are taken in the order of seconds (whole numbers), then order.
    A key's rows are cut into parts that several tasks run, see operators.blocks. Rows of a null key are one key.
    """
    if (gap is None) == (cap is None):
        raise ValueError("either gap or cap with span")
    machine = Gap(seconds, gap) if cap is None else Cap(seconds, cap, span)
    return sequences(rows, keys, [seconds, order], machine)


def streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """key, start, stop, length of every run of consecutive days. Repeated days count once, null ones not at all."""
    rows = days.select(key, F.col(day).cast("date").alias("day")).filter("day is not null").distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy("day"))
    island = rows.withColumn("island", F.date_sub(F.col("day"), place))
    return island.groupBy(key, "island").agg(F.min("day").alias("start"), F.max("day").alias("stop"), F.count(F.lit(1)).alias("length")).drop("island")


def diversified(rows: DataFrame, group: str, rank: list, per_tag: str, limit: int, most: int) -> DataFrame:
    """The best limit rows of each group with at most `most` of one tag; if that leaves room, the next best of any tag.

    rank: sort columns, the last of which makes the order total. Adds place, from 1.
    """
    within = F.row_number().over(Window.partitionBy(group, per_tag).orderBy(*rank))
    # a row with limit better ones of its tag isn't among the best, so few rows of a tag are left, and Spark cuts them before the shuffle
    spill = rows.withColumn("within", within).filter(F.col("within") <= limit).withColumn("spill", (F.col("within") > most).cast("int")).drop("within")
    place = F.row_number().over(Window.partitionBy(group).orderBy("spill", *rank))
    return spill.withColumn("place", place).filter(F.col("place") <= limit).drop("spill")
