"""Visibility, filters and sorts that come as data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of spans as users write them.
UNITS = {"h": "hours", "d": "days", "w": "weeks", "mo": "months", "y": "years"}


def permitted(denied: list[int], mine: Column) -> Column:
    """Whether a row (tags, is_private, hidden_at) may be seen: no denied tag; private and hidden rows only where `mine` holds."""
    untagged = ~F.coalesce(F.arrays_overlap("tags", F.array(*(F.lit(t).cast("long") for t in denied))), F.lit(False)) if denied else F.lit(True)
    return untagged & (~F.col("is_private") | mine) & (F.col("hidden_at").isNull() | mine)


def gated(hits: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """The hits whose key is among the visible ones, each with how many hits were dropped."""
    known = visible.select(key).distinct().withColumn("_seen", F.lit(True))
    marked = hits.join(known, key, "left")
    dropped = marked.agg(F.count_if(F.col("_seen").isNull()).alias("dropped"))  # one row
    return marked.filter("_seen").drop("_seen").crossJoin(F.broadcast(dropped))


def ranges(asked: dict, columns: dict[str, str | None]) -> tuple[Column, list[str]]:
    """A condition from ranges by field, and the fields that were left out because no column stands for them."""
    ops = {
        ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
        "=": lambda c, v: c == v, "..": lambda c, v: c.between(*v)
    }
    out, ignored = F.lit(True), []
    for field, bounds in asked.items():
        column = columns.get(field)
        if column is None:
            ignored.append(field)
            continue
        for op, value in bounds:
            out = out & ops[op](F.col(column), value)
    return out, ignored


def since(ts: Column, span: str, now: str) -> Column:
    """Whether a time lies in a span: "7d", "3w", "6mo", "1y", "12h" back from now, today, yesterday, a year, month or day whole."""
    at = F.lit(now).cast("timestamp_ntz")
    if back := re.fullmatch(r"(\d+)(h|d|w|mo|y)", span):
        return ts > at - F.expr(f"interval {back[1]} {UNITS[back[2]]}")
    if span in ("today", "yesterday"):
        begin = F.date_trunc("DAY", at).cast("timestamp_ntz") - F.expr(f"interval {int(span == 'yesterday')} days")
        return (ts >= begin) & (ts < begin + F.expr("interval 1 day"))
    parts = span.split("-")
    begin = F.lit("-".join([*parts, "01", "01"][: max(3, len(parts))])).cast("timestamp_ntz")
    return (ts >= begin) & (ts < begin + F.expr(f"interval 1 {('year', 'month', 'day')[len(parts) - 1]}"))


def optional(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with the columns that it lacks, each filled with what stands for it."""
    return rows.withColumns({name: value for name, value in defaults.items() if name not in rows.columns})


def ordered(sorts: dict[str, list[str]], name: str | None, default: list[str]) -> list[Column]:
    """The sort columns of a name ("-" before a column: descending), those of the default for any other; nulls last."""
    keys = sorts.get(name or "", default)
    return [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys]


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of sorted rows: 1 to 50 of them, from an offset of 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(50, max(1, limit)))
