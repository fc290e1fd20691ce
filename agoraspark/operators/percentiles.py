"""Exact nearest-rank percentiles of large groups, without sorting the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGIN = 0.002
ACCURACY = 10_000  # the sketch's rank error is at most 1 / ACCURACY, well within MARGIN


def _floor_rank(n: Column, share: Column) -> Column:
    return F.floor(n * share)


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: list[float], rank_of: Callable[[Column, Column], Column] = _floor_rank) -> DataFrame:
    """key, share, n and the value of rank floor(n * share), counted from 0 and at most n - 1, for each group and share.

    rank_of may give another rank, not more than one away from n * share.

    A sketch bounds where each percentile lies; rows below the bound are counted, and only the few rows within the
    bounds are ranked. Both passes combine before their shuffle, so a group may hold most of all rows. Null values are
    left out; a group of nulls alone has no row.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(value).alias("value")).filter("value is not null")
    low = [max(0.0, s - MARGIN) for s in shares]
    high = [min(1.0, s + MARGIN) for s in shares]
    sketch = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", low, ACCURACY).alias("low"),
        F.percentile_approx("value", high, ACCURACY).alias("high"),
    )
    bounds = sketch.select(
        "key", "n", F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), "low", "high")).alias("b")
    ).select("key", "n", "b.share", "b.low", "b.high")
    spread = rows.join(sketch.select("key", F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), "low", "high").alias("bounds")), "key")
    below = spread.select("key", "value", F.explode("bounds").alias("b")).groupBy("key", F.col("b.share").alias("share"))
    counted = below.agg(F.count_if(F.col("value") < F.col("b.low")).alias("below"))
    within = spread.select("key", "value", F.explode("bounds").alias("b")).filter("value between b.low and b.high")
    tallied = within.groupBy("key", F.col("b.share").alias("share"), "value").count()
    before = F.sum("count").over(Window.partitionBy("key", "share").orderBy("value")) - F.col("count")
    ranked = tallied.withColumn("before", before).join(counted, ["key", "share"]).join(bounds.select("key", "share", "n"), ["key", "share"])
    rank = F.greatest(F.least(rank_of(F.col("n"), F.col("share")), F.col("n") - 1), F.lit(0)) - F.col("below")
    hit = ranked.filter((rank >= F.col("before")) & (rank < F.col("before") + F.col("count")))
    return hit.select(F.col("key").alias(key), "share", "n", F.col("value").alias(value))


def nearest_ranks(rows: DataFrame, key: str, value: str, percents: list[int]) -> DataFrame:
    """key, p and value: for each percentage the row of place p * n / 100 + 0.5, rounded half to even and counted from 1."""
    place = lambda n, share: F.bround(n * F.round(share * 100) / 100 + 0.5) - 1
    found = exact_percentiles(rows, key, value, [p / 100 for p in percents], place)
    return found.select(key, F.round(F.col("share") * 100).cast("int").alias("p"), value)
