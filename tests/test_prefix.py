"""Running sums in two levels against plain ones."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from agoraspark.operators.matching import by_position, positional_merge
from agoraspark.operators.prefix import running


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_running_sums_of_a_hot_key(spark, parts):
    rng = random.Random(parts)
    made = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice(["x", None]), i, rng.randrange(-9, 20)) for i in range(700)]
    df = spark.createDataFrame(made, "k long, k2 string, id long, v long").repartition(4)
    for keys in (["k", "k2"], ["k"], []):
        sums, want = defaultdict(int), {}
        for r in sorted(made, key=lambda r: r[2]):
            own = tuple({"k": r[0], "k2": r[1]}[x] for x in keys)
            sums[own] += r[3]
            want[r[2]] = sums[own]
        got = running(df, keys, ["id"], F.col("v"), "upto", parts)
        assert {r["id"]: r["upto"] for r in got.collect()} == want and got.columns == [*df.columns, "upto"]
    places = running(df.filter("k = 1"), ["k"], ["id"], parts=parts)
    assert [r["place"] for r in places.orderBy("id").collect()] == list(range(1, places.count() + 1))
    if parts > 1:
        assert df.filter("k = 1").count() > 300 and places.select(F.spark_partition_id()).distinct().count() > 1
    assert running(df.limit(0), ["k"], ["id"]).count() == 0


def test_merges_by_place(spark):
    side = lambda key, n, add: [(key, (i + add,)) for i in range(n)]
    schema = "k long, row struct<x: long>"
    left = spark.createDataFrame(side(1, 40, 0) + side(2, 3, 0) + side(3, 2, 5), schema)
    right = spark.createDataFrame(side(1, 40, 100) + side(2, 2, 0) + side(3, 2, 7), schema)
    got = {(r["k"], r["place"]): (r["left"]["x"], r["right"]["x"]) for r in positional_merge(left, right, "k", "row").collect()}
    assert got == {(1, i + 1): (i, i + 100) for i in range(40)} | {(3, i + 1): (i + 5, i + 7) for i in range(2)}
    wanted = spark.createDataFrame([(1, 7), (2, 9), (3, 1), (1, 7)], "k long, place long")
    assert sorted((r["k"], r["place"], r["row"]["x"]) for r in by_position(wanted, left, "k", "place", "row").collect()) == [(1, 7, 6), (1, 7, 6), (3, 1, 5)]
