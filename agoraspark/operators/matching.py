"""Joins that Spark has no operator for: either-key self joins, ladders, merges by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraspark.operators.prefix import running


def coread_pairs(visits: DataFrame, min_pairs: int = 1) -> DataFrame:
    """a, b (items, a < b), pairs and weight over all pairs of visits that share a user (other than 0) or a session.

    visits: uid, session, item, w. The condition on either key is taken apart into two hash joins; the second leaves out
    pairs that the first has, so none counts twice. Visits of one key and item are summed up before they meet, since a
    pair's weight is a product: sums of products are products of sums. Only pairs of different items come out, which
    per key are bounded by the square of the distinct items, not of the visits.
    """
    both = visits.groupBy("uid", "session", "item").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))

    def paired(rows: DataFrame, *keys: str) -> DataFrame:
        left, right = (rows.select(*keys, F.col("item").alias(i), F.col("n").alias(f"n_{i}"), F.col("w").alias(f"w_{i}")) for i in ("a", "b"))
        met = left.join(right, list(keys)).filter("a < b")
        return met.groupBy("a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pairs"), F.sum(F.col("w_a") * F.col("w_b")).alias("weight"))

    summed = lambda *keys: both.groupBy(*keys, "item").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    by_user = paired(summed("uid").filter("uid <> 0"), "uid")
    by_session = paired(summed("session").filter("session is not null"), "session")
    by_both = paired(both.filter("uid <> 0 and session is not null"), "uid", "session")
    taken = by_both.select("a", "b", (-F.col("pairs")).alias("pairs"), (-F.col("weight")).alias("weight"))
    total = reduce(DataFrame.unionByName, [by_user, by_session, taken]).groupBy("a", "b").agg(F.sum("pairs").alias("pairs"), F.sum("weight").alias("weight"))
    return total.filter(F.col("pairs") >= min_pairs)


def coread_delta(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """a, b, pairs and weight by which coread_pairs grows from before to after; signed, without what stays.

    changed: uid and session of the visits that were added or taken away. Only visits of those users and sessions are paired, before
    and after: pairs that didn't change are in both and cancel.
    """
    users = changed.select("uid").filter("uid <> 0").distinct().withColumn("_user", F.lit(True))
    sessions = changed.select("session").filter("session is not null").distinct().withColumn("_session", F.lit(True))

    def touched(visits: DataFrame) -> DataFrame:
        return visits.join(users, "uid", "left").join(sessions, "session", "left").filter("_user or _session").drop("_user", "_session")

    gone = coread_pairs(touched(before), min_pairs=0).select("a", "b", (-F.col("pairs")).alias("pairs"), (-F.col("weight")).alias("weight"))
    both = coread_pairs(touched(after), min_pairs=0).unionByName(gone)
    return both.groupBy("a", "b").agg(F.sum("pairs").alias("pairs"), F.sum("weight").alias("weight")).filter("pairs <> 0 or weight <> 0")


def coread_applied(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The pairs after a delta; those of which none are left go."""
    both = state.unionByName(delta.select(*state.columns))
    return both.groupBy("a", "b").agg(F.sum("pairs").alias("pairs"), F.sum("weight").alias("weight")).filter("pairs > 0")


def ladder_lookup(rows: DataFrame, value: str, rungs: list[tuple[str, float]]) -> DataFrame:
    """Adds rung (the highest whose threshold is reached, null below all) and next_at (the next threshold, null on top).

    The rungs are few and literal, so the lookup is an expression and no join.
    """
    rungs = sorted(rungs, key=lambda r: r[1])
    rung, next_at = F.lit(None).cast("string"), F.lit(rungs[0][1] if rungs else None).cast("double")
    for i, (name, at) in enumerate(rungs):
        reached, above = F.col(value) >= at, rungs[i + 1][1] if i + 1 < len(rungs) else None
        rung, next_at = F.when(reached, F.lit(name)).otherwise(rung), F.when(reached, F.lit(above).cast("double")).otherwise(next_at)
    return rows.withColumns({"rung": rung, "next_at": next_at})


def positional_merge(left: DataFrame, right: DataFrame, key: str, row: str) -> DataFrame:
    """key, place (from 1), left and right: the i-th rows of both sides of a key, for keys with equally many on both.

    row is a struct whose order is the sequence. Keys with unequal counts are left out whole.
    """
    counted = [side.groupBy(key).agg(F.count(F.lit(1)).alias("n")) for side in (left, right)]
    equal = counted[0].join(counted[1], [key, "n"]).select(key)
    sides = ((left, "left"), (right, "right"))
    placed = [running(side.join(equal, key), [key], [row]).select(key, F.col(row).alias(name), "place") for side, name in sides]
    return placed[0].join(placed[1], [key, "place"]).select(key, "place", "left", "right")


def by_position(wanted: DataFrame, rows: DataFrame, key: str, place: str, row: str) -> DataFrame:
    """wanted (key, place) with the place-th row of each key's sequence; places beyond its end have none.

    row is a struct whose order is the sequence. Only keys that are wanted are numbered.
    """
    asked = rows.select(key, row).join(wanted.select(key).distinct(), key, "left_semi")
    return wanted.withColumn(place, F.col(place).cast("long")).join(running(asked, [key], [row], name=place), [key, place])


def not_in(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows for which key NOT IN (others' key) holds, nulls as SQL has them.

    If the others hold a null nothing is left; a null key is left only if there are no others. Both are counted in one row.
    """
    known = others.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(key).isNull()).alias("_nulls"))  # one row
    apart = rows.join(others.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti").crossJoin(F.broadcast(known))
    holds = (F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())
    return apart.filter(holds).select(*rows.columns)
