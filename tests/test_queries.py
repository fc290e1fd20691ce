"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from agoraspark.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "isoformat"):
        return str(value).replace("T", " ")[:19]
    return float(value) if type(value).__name__ == "Decimal" else value


def sorted_rows(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted_rows(got.select(*columns).collect()) == sorted_rows(tuple(r[i] for i in at) for r in want.fetchall())


def test_queries_without_sql_run(spark):
    rest = sorted(registry.queries().keys() - registry.oracle_sql().keys())
    assert rest == ["txt_balance"]  # test_operators holds it against brute force
    assert all(registry.queries()[name](spark, DATA).count() for name in rest)


def test_related_items_bring_all_that_is_similar(spark, duck):
    """content of an asked item isn't cut to its nearest vectors."""
    from pyspark.sql import functions as F

    assert "<= 32" not in registry.oracle_sql()["rec_coread_related"]
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    spark_rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    from agoraspark.operators.vectors import cosine_within

    got = cosine_within(spark_rows.filter("vec_id = 10"), spark_rows, "vec_id", "embedding", -1.0)
    assert got.count() == len(rows) - 1 and got.agg(F.min("score")).first()[0] < 0


def test_batches_that_break_their_bounds_are_seen(spark):
    """the report says whether batches are bounded and filled, and counts all of them."""
    from agoraspark.plans.records import batch_report

    def report(*rows):
        return tuple(batch_report(spark.createDataFrame([*rows], "lines string, n long, bytes long, last boolean"), 10, 2).first())

    full = ("ab\ncd", 2, 6, False)
    assert report(full, ("abc", 1, 4, True)) == (10, 3, True, True)
    assert report(full, ("ab\ncd\nef", 3, 9, False)) == (15, 5, False, True)
    assert report(full, ("abcdefghijk", 1, 12, True)) == (18, 3, False, True)
    assert report(full, ("abc", 1, 4, False)) == (10, 3, True, False)
    assert report() == (None, 0, True, True)


def test_overlaps_in_shards(spark):
    """an item that many hold is counted in many tasks, to the same pairs."""
    from pyspark.sql import functions as F

    from agoraspark.plans.search import overlaps

    held = spark.range(600).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 3)).alias("item"))
    listed = lambda df: sorted(map(tuple, df.collect()))
    rows = [tuple(r) for r in held.collect()]
    want = {}
    for a, i in rows:
        for b, j in rows:
            if a % 100 == 0 and a != b and i == j:
                want[a, b] = want.get((a, b), 0) + 1
    few = overlaps(held, 2, 200)
    assert listed(few) == listed(overlaps(held, 2)) == sorted((*k, n) for k, n in want.items())
    assert overlaps(held, 2, 200).rdd.getNumPartitions() and overlaps(held.limit(0), 2).count() == 0
    assert "REPARTITION_BY_NUM" in few._jdf.queryExecution().executedPlan().toString()
