"""Sequences whose steps depend on the steps before, over many tasks: a key's rows are cut into parts that are run side by side.

Rows are dealt to parts by ranges of key and order, so a large key is in many parts and a part begins in at most one key that began before.
Every part is run from the start of a sequence, and says in what state it ends. Where a part goes on with a key, the
state that the part before ended in takes effect: a machine's summary gives the end for it without another run where it can (where
the last counted row lies within a gap; how low the balance may be at first), else the part is run again. This is
repeated until every part has begun in the state that the one before it ends in, so the result is that of one long run. What the driver
holds is a state and a bounded summary for each part. States that forget their past, as these do, settle in a few rounds.

A part is in memory at a time, which is what a task of a range-partitioned sort holds. Within it steps are taken by arrays: over next
rows that count, or over stretches without a refusal. Null keys are one key.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agoraspark.sources.files import materialised

MOST_STEPS = 1 << 14  # of a summary; longer ones aren't kept
CHUNK = 512


class Gap:
    """accepted: the last accepted row is at least gap older. column: whole numbers in order. State: when the last one was."""

    adds = {"accepted": pa.bool_()}

    def __init__(self, column: str, gap: int) -> None:
        self.columns, self.gap = [column], gap

    def start(self) -> None:
        return None

    def _next(self, s: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(s, s + self.gap), np.arange(1, len(s) + 1))

    def run(self, s: np.ndarray, last: int | None) -> tuple[list[np.ndarray], int | None]:
        n = len(s)
        first = 0 if last is None else int(np.searchsorted(s, last + self.gap))
        accepted, jump = np.zeros(n + 1, bool), np.append(self._next(s), n)
        reached = np.array([first])
        while jump[first] < n:  # rows reached in twice as many jumps each time
            reached = np.unique(np.append(reached, jump[reached]))
            jump = jump[jump]
        reached = np.unique(np.append(reached, jump[reached]))
        accepted[reached] = True
        at = np.flatnonzero(accepted[:n])
        return [accepted[:n]], int(s[at[-1]]) if len(at) else last

    def summary(self, s: np.ndarray) -> tuple | None:
        """For each end of the sequence before, up to a time: the last row that counts here."""
        n, jump = len(s), self._next(s)
        jump = np.where(jump < n, jump, np.arange(n))
        while (further := jump[jump]).tolist() != jump.tolist():
            jump = further
        m = min(n, int(np.searchsorted(s, s[0] + self.gap)) + 1)
        limits, ends = s[:m] - self.gap, s[jump[:m]]
        kept = np.append(ends[1:] != ends[:-1], True)
        limits, ends = limits[kept], ends[kept]
        return (limits.tolist(), ends.tolist()) if len(limits) <= MOST_STEPS else None

    def apply(self, summary: tuple, last: int | None) -> tuple[bool, int | None]:
        limits, ends = summary
        if last is None:
            return True, ends[0]
        at = bisect_left(limits, last)
        return True, ends[at] if at < len(ends) else last


class Cap:
    """accepted: fewer than cap rows were accepted within the last span. State: the last cap times that were."""

    adds = {"accepted": pa.bool_()}

    def __init__(self, column: str, cap: int, span: int) -> None:
        self.columns, self.cap, self.span = [column], cap, span

    def start(self) -> tuple:
        return ()

    def run(self, s: np.ndarray, times: tuple) -> tuple[list[np.ndarray], tuple]:
        at, last, accepted, i = s.tolist(), list(times), [], 0
        while i < len(at):  # from one accepted row to the next
            if len(last) >= self.cap:
                i = bisect_left(at, last[-self.cap] + self.span, i)
                if i == len(at):
                    break
            accepted.append(i)
            last.append(at[i])
            i += 1
        out = np.zeros(len(at), bool)
        out[accepted] = True
        return [out], tuple(last[-self.cap :])

    def summary(self, s: np.ndarray) -> tuple | None:
        """Where the sequence is as long as the span, its end is often the same whatever was before; no more can be said."""
        return None

    def apply(self, summary: Any, times: tuple) -> tuple[bool, tuple]:
        return False, times


class Guard:
    """granted and balance: a negative delta is granted if the balance of what was granted covers it. State: the balance."""

    adds = {"granted": pa.bool_(), "balance": pa.int64()}

    def __init__(self, column: str) -> None:
        self.columns = [column]

    def start(self) -> int:
        return 0

    def run(self, delta: np.ndarray, balance: int) -> tuple[list[np.ndarray], int]:
        granted, after, i = np.ones(len(delta), bool), np.empty(len(delta), np.int64), 0
        while i < len(delta):  # from one refusal to the next
            sums = balance + np.cumsum(delta[i : i + CHUNK])
            low = np.flatnonzero((sums < 0) & (delta[i : i + CHUNK] < 0))
            n = int(low[0]) if len(low) else len(sums)
            after[i : i + n] = sums[:n]
            balance = int(sums[n - 1]) if n else balance
            if len(low):
                granted[i + n], after[i + n] = False, balance
            i += n + bool(len(low))
        return [granted, after], balance

    def summary(self, delta: np.ndarray) -> tuple[int, int]:
        """The least balance with which nothing is refused, and what is added then."""
        sums = np.cumsum(delta)
        return max(0, -int(sums.min())), int(sums[-1])

    def apply(self, summary: tuple, balance: int) -> tuple[bool, int]:
        least, total = summary
        return balance >= least, balance + total


def _runs(table: pa.Table, keys: list[str]) -> list[tuple[bytes, int, int]]:
    """Key, begin and end of each stretch of rows of one key."""
    if not table.num_rows:
        return []
    coded = [table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
    changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in coded], axis=0)) + 1
    cuts = [0, *changes.tolist(), table.num_rows]
    return [(pickle.dumps(tuple(table.column(k)[a].as_py() for k in keys)), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def sequences(rows: DataFrame, keys: list[str], order: list[str], machine: Gap | Cap | Guard, parts: int | None = None) -> DataFrame:
    """rows and what the machine adds, for each key's rows in order (which should be total)."""
    spark, names = rows.sparkSession, rows.columns
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = "_part"
    dealt = materialised(rows.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id()), "sequence-parts")

    def together(df: DataFrame) -> DataFrame:
        return df.repartitionById(n, part).sortWithinPartitions(part, *keys, *order)

    def values(table: pa.Table, a: int, b: int) -> list[np.ndarray]:
        return [table.column(c).slice(a, b - a).to_numpy() for c in machine.columns]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield held[0].column(held[0].schema.get_field_index(part))[0].as_py(), pa.Table.from_batches(held)

    def ends(begun: dict[int, Any], summaries: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, table in tables(batches):
                runs = _runs(table, keys)
                (first, _, _), (last, a, b) = runs[0], runs[-1]
                state = begun.get(number, machine.start()) if len(runs) == 1 else machine.start()
                end = machine.run(*values(table, a, b), state)[1]
                more = machine.summary(*values(table, a, b)) if summaries and len(runs) == 1 else None
                yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "first": [first], "last": [last], "alone": [len(runs) == 1], "said": [pickle.dumps((end, more))]})

        chosen = dealt if summaries else dealt.filter(F.col(part).isin(sorted(begun)))
        return together(chosen.select(part, *dict.fromkeys([*keys, *order, *machine.columns]))).mapInArrow(run, "part int, first binary, last binary, alone boolean, said binary")

    known = {r["part"]: [r["first"], r["last"], r["alone"], *pickle.loads(r["said"])] for r in ends({}, True).collect()}  # a row a part
    begun: dict[int, Any] = {}
    while True:
        again: dict[int, Any] = {}
        before = None
        for number in sorted(known):
            first, _, alone, _, summary = known[number]
            state = known[before][3] if before is not None and known[before][1] == first else machine.start()
            if state != begun.get(number, machine.start()):
                begun[number] = state
                if alone:
                    sure, end = machine.apply(summary, state) if summary is not None else (False, None)
                    if sure:
                        known[number][3] = end
                    else:
                        again[number] = state
            before = number
        if not again:
            break
        for r in ends(again, False).collect():
            known[r["part"]][3] = pickle.loads(r["said"])[0]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in tables(batches):
            found: list[list[np.ndarray]] = []
            for i, (_, a, b) in enumerate(_runs(table, keys)):
                found.append(machine.run(*values(table, a, b), begun.get(number, machine.start()) if i == 0 else machine.start())[0])
            out = table.select(names)
            for (name, kind), columns in zip(machine.adds.items(), zip(*found, strict=True), strict=True):
                out = out.append_column(name, pa.array(np.concatenate(columns), kind))
            yield from out.to_batches(max_chunksize=10_000)

    kinds = {pa.bool_(): "boolean", pa.int64(): "long"}
    schema = StructType(list(rows.schema.fields))
    for name, kind in machine.adds.items():
        schema.add(name, kinds[kind])
    return together(dealt).mapInArrow(final, schema)
