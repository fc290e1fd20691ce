"""Dependent sequences in parts against one long run in plain Python."""

import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from agoraspark.operators import blocks


def plain_gap(times, gap):
    last, out = None, []
    for t in times:
        out.append(last is None or t - last >= gap)
        last = t if out[-1] else last
    return out


def plain_cap(times, cap, span):
    kept, out = deque(maxlen=cap), []
    for t in times:
        out.append(len(kept) < cap or t - kept[0] >= span)
        if out[-1]:
            kept.append(t)
    return out


def plain_guard(deltas):
    balance, out = 0, []
    for d in deltas:
        fits = d >= 0 or balance + d >= 0
        balance += d if fits else 0
        out.append((fits, balance))
    return out


def rows(rng, kind):
    """Key, seconds, id, delta: one hot key with most rows, small ones, a null one."""
    keys = [1] * 900 + [rng.randrange(2, 12) for _ in range(80)] + [None] * 40
    if kind == "regular":
        return [(k, 10 * i, i, (-7 if i % 3 else 9)) for i, k in enumerate(keys)]
    return [(k, rng.randrange(4000) if kind == "random" else rng.randrange(3) * 900, i, rng.randrange(-60, 60 if kind == "random" else 50)) for i, k in enumerate(keys)]


def by_key(made, order):
    out = defaultdict(list)
    for r in sorted(made, key=order):
        out[r[0]].append(r)
    return out


@pytest.mark.parametrize("kind", ["random", "regular", "ties"])
@pytest.mark.parametrize("parts", [1, 13])
def test_parts_equal_one_run(spark, kind, parts):
    made = rows(random.Random(3), kind)
    df = spark.createDataFrame(made, "k long, s long, id long, d long").withColumn("accepted_", F.lit("x")).repartition(5)
    for machine, plain in ((blocks.Gap("s", 55), lambda x: plain_gap(x, 55)), (blocks.Cap("s", 3, 170), lambda x: plain_cap(x, 3, 170))):
        got = {r["id"]: r["accepted"] for r in blocks.sequences(df, ["k"], ["s", "id"], machine, parts).collect()}
        want = {r[2]: a for own in by_key(made, lambda r: (r[1], r[2])).values() for r, a in zip(own, plain([r[1] for r in own]), strict=True)}
        assert got == want
    got = {r["id"]: (r["granted"], r["balance"]) for r in blocks.sequences(df, ["k"], ["id"], blocks.Guard("d"), parts).collect()}
    want = {r[2]: a for own in by_key(made, lambda r: r[2]).values() for r, a in zip(own, plain_guard([r[3] for r in own]), strict=True)}
    assert got == want


def test_a_hot_key_is_in_many_parts(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.lit(2).alias("k2"), F.col("id").alias("s"), "id")
    out = blocks.sequences(df, ["k", "k2"], ["s", "id"], blocks.Gap("s", 7), 10)
    assert out.filter("accepted").count() == 715
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    assert blocks.sequences(df.limit(0), ["k"], ["s", "id"], blocks.Gap("s", 7)).count() == 0


def test_summaries_say_what_a_run_would():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = np.sort(rng.integers(0, rng.choice([30, 300]), rng.integers(1, 40)))
        gap = blocks.Gap("s", int(rng.integers(0, 60)))
        summary = gap.summary(s)
        for last in [None, *range(int(s[0]) - 70, int(s[0]) + 1)]:
            assert gap.apply(summary, last) == (True, gap.run(s, last)[1])
        delta = rng.integers(-50, 60, 1200 if rng.random() < 0.05 else 30)
        guard = blocks.Guard("d")
        for balance in (0, 5, 60, 3000, 10**6):
            sure, end = guard.apply(guard.summary(delta), balance)
            assert not sure or end == guard.run(delta, balance)[1]
