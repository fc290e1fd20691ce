"""Streams that stop and go on, and changes of the co-read matrix, against whole runs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from agoraspark.operators.matching import coread_applied, coread_delta, coread_pairs, not_in
from agoraspark.streaming import spool


def plain_capped(rows, cap, span):
    kept, out = defaultdict(list), set()
    for key, row, at in sorted(rows, key=lambda r: (r[2], r[1])):
        own = kept[key]
        if len(own) < cap or at - own[-cap] >= span:
            own.append(at)
            out.add(row)
    return out


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(4), i, rng.randrange(100_000)) for i in range(400)] + [(9, 1000, 10), (9, 1001, 60_000), (9, 1002, 99_999)]
    df = spark.createDataFrame(rows, "k long, row long, s long")
    folder = f"file://{tmp_path}/spool"
    seen = []
    for low, high in ((0, 30_000), (30_000, 30_001), (30_001, 70_000), (70_000, 100_000)):
        spool.append(df.filter(F.col("s").between(low, high - 1)), folder)
        stream = spark.readStream.schema("k long, row long, s long").json(folder)
        spool.replay(spool.capped(stream, "k", "row", "s", cap=2, span=5_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        seen.append(spark.read.parquet(f"{tmp_path}/out").count())
    got = [r["row"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_capped(rows, 2, 5_000)
    assert seen == sorted(seen) and seen[0] > 0
    spool.replay(spool.capped(stream, "k", "row", "s", cap=2, span=5_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)  # nothing new, nothing again
    assert spark.conf.get(spool.STORE) != spool.ROCKS


def pairs(df):
    return {(r["a"], r["b"]): (r["pairs"], r["weight"]) for r in df.collect()}


def test_changes_of_the_matrix_equal_a_rebuild(spark):
    rng = random.Random(1)
    schema = "uid long, session string, item long, w long, id long"
    rows = [(rng.randrange(8), rng.choice(["a", "b", "c", None]), rng.randrange(6), rng.randrange(1, 9), i) for i in range(120)]
    for changed_users in ({3}, {0}, set(range(8)), set()):
        gone = {r[4] for r in rows if r[0] in changed_users and rng.random() < 0.5}
        came = {r[4] for r in rows if r[0] in changed_users and r[4] not in gone and rng.random() < 0.5}
        frame = lambda keep: spark.createDataFrame([r for r in rows if keep(r)], schema)  # noqa: E731, B023
        before, after = frame(lambda r: r[4] not in came), frame(lambda r: r[4] not in gone)  # noqa: B023
        changed = spark.createDataFrame([r for r in rows if r[4] in came | gone], schema)
        delta = coread_delta(before, after, changed)
        assert pairs(coread_applied(coread_pairs(before, min_pairs=1), delta)) == pairs(coread_pairs(after, min_pairs=1))
        assert (delta.count() == 0) == (not changed_users)


def test_not_in_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, k string")
    others = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    ids = lambda o: sorted(r["id"] for r in not_in(rows, o, "k").collect())
    assert ids(others("a")) == [2] and ids(others("a", None)) == [] and ids(others()) == [1, 2, 3]
