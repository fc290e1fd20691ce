"""Ranges of ids of about equal weight, from exact sums rather than a sample, so that equal tables are cut alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16


def id_ranges(sizes: DataFrame, target: int) -> list[tuple[int, int]]:
    """First id and weight of ranges of about target, in order. sizes: id (long, not null), n (weight).

    Weights are summed over BUCKETS ranges of ids; ranges heavier than target are summed again in finer ones, down to
    single ids, which alone may be heavier. About BUCKETS sums reach the driver at each level. None for an empty table.
    """
    low, high = sizes.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return []
    width, heavy, leaves = high - low + 1, [0], []
    parent = F.lit(0).cast("long")
    while heavy:
        fine = max(1, -(-width // max(2, BUCKETS // len(heavy))))
        offset = F.col("id") - F.lit(low)
        key = (offset - offset % F.lit(fine)).cast("long")
        level = sizes.filter(parent.isin(heavy)) if leaves or width < high - low + 1 else sizes
        sums = level.groupBy(parent.alias("parent"), key.alias("key")).agg(F.sum("n").alias("n")).collect()
        heavy_next = []
        for p, k, n in sums:
            start = max(p, k)  # keys of one parent that aren't multiples of its width are cut at it
            if n > target and fine > 1:
                heavy_next.append(start)
            else:
                leaves.append((start, n))
        if heavy_next and fine == width:
            break
        parent, width, heavy = F.greatest(parent, key), fine, heavy_next
    out: list[tuple[int, int]] = []
    for start, n in sorted(leaves):
        if out and out[-1][1] + n <= target:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((low + start, n))
    return out


class Deal:
    """Numbers of shards for ids: ranges in order, those heavier than target in as many shards as that takes.

    ranges: as id_ranges gives them; missing: weight of the rows without an id, which come first.
    """

    def __init__(self, ranges: list[tuple[int, int]], target: int, missing: int = 0) -> None:
        self.firsts = np.array([first for first, _ in ranges], np.int64)
        self.parts = np.array([-(-missing // target), *(max(1, -(-n // target)) for _, n in ranges)], np.int64)
        if not ranges:
            self.parts[0] = max(1, self.parts[0])
        self.bases = np.cumsum(self.parts) - self.parts
        self.shards = int(self.parts.sum())

    def place(self, ids: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shard of each id, and how many it has."""
        at = np.maximum(np.searchsorted(self.firsts, ids, side="right"), min(1, len(self.firsts)))
        at = np.where(missing, 0, at)
        return self.bases[at].astype(np.int32), np.maximum(1, self.parts[at]).astype(np.int32)

    def of(self, ids: np.ndarray, missing: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The shard of each id. salt: what tells rows of one id apart; it decides only among the shards of one id."""
        bases, parts = self.place(ids, missing)
        return (bases + salt % parts).astype(np.int32)
