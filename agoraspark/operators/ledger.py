"""Append-only ledgers: idempotent entries, balances, guarded spending, and comparison of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoraspark.operators.blocks import Guard, sequences


def idempotent(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One entry per key: the first by order. A null in a key counts as a value, so such entries are one as well."""
    rest = [c for c in entries.columns if c not in keys]
    first = F.min(F.struct(*order, *(c for c in rest if c not in order)))
    return entries.groupBy(*keys).agg(first.alias("x")).select(*keys, *(F.col("x")[c].alias(c) for c in rest)).select(*entries.columns)


def balances(entries: DataFrame, key: str, delta: str, counts: Column | None = None) -> DataFrame:
    """key, balance and lifetime: the sum of all entries, and of the positive ones for which counts holds."""
    earns = F.greatest(F.col(delta), F.lit(0)) if counts is None else F.when(counts, F.greatest(F.col(delta), F.lit(0))).otherwise(0)
    return entries.groupBy(key).agg(F.sum(delta).alias("balance"), F.sum(earns).alias("lifetime"))


def guarded(entries: DataFrame, key: str, delta: str, order: list[str]) -> DataFrame:
    """Adds granted and balance: a negative entry is granted only if the balance, of what was granted so far, covers it.

    Entries of a key are cut into parts that several tasks run, see operators.blocks. Entries of a null key are one key.
    """
    return sequences(entries, [key], order, Guard(delta))


def drift(stored: DataFrame, recomputed: DataFrame, key: str, value: str) -> DataFrame:
    """key, stored, actual for keys whose values differ; a key that one side lacks counts as 0 there."""
    a, b = stored.select(key, F.col(value).alias("stored")), recomputed.select(key, F.col(value).alias("actual"))
    both = a.join(b, key, "full").select(key, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("stored", "actual")))
    return both.filter("stored <> actual")


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: added, removed or kept."""
    a, b = before.select(*keys).distinct().withColumn("was", F.lit(True)), after.select(*keys).distinct().withColumn("is", F.lit(True))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("kept")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))
