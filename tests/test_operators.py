"""Operators on small literal inputs: nulls, ties, empty tables, and streams against their batch forms."""

import datetime as dt
import json

from pyspark.sql import functions as F

from agoraspark.operators.ledger import changes, drift, guarded, idempotent
from agoraspark.operators.matching import coread_pairs, ladder_lookup, positional_merge
from agoraspark.operators.percentiles import exact_percentiles
from agoraspark.operators.search import filters, phrase
from agoraspark.operators.sequences import accepted_rows, diversified, streaks
from agoraspark.operators.vectors import centroids, cosine_top_k
from agoraspark.sources.files import balanced, json_batches, read_events_json
from agoraspark.streaming.state import anchored_views, applied, drain


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_coread_counts_a_pair_once(spark):
    visits = spark.createDataFrame([(1, "s", 1, 2), (1, "s", 2, 3), (0, "t", 1, 1), (0, "t", 3, 1), (5, None, 1, 1), (5, None, 2, 1)], "uid long, session string, item long, w long")
    assert rows(coread_pairs(visits)) == [(1, 2, 2, 7), (1, 3, 1, 1)]
    assert rows(coread_pairs(visits.limit(0))) == []


def test_ladder(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (9.9,), (10.0,), (None,)], "p double")
    got = {r[0]: (r[1], r[2]) for r in ladder_lookup(df, "p", [("a", 0.0), ("b", 10.0)]).collect()}
    assert got == {-1.0: (None, 0.0), 0.0: ("a", 10.0), 9.9: ("a", 10.0), 10.0: ("b", None), None: (None, 0.0)}


def test_positions_need_equal_counts(spark):
    left = spark.createDataFrame([(1, (1,)), (1, (2,)), (2, (1,))], "k long, row struct<i:long>")
    right = spark.createDataFrame([(1, (7,)), (1, (5,)), (2, (1,)), (2, (2,))], "k long, row struct<i:long>")
    got = positional_merge(left, right, "k", "row").select("k", "place", "left.i", F.col("right.i").alias("j"))
    assert rows(got) == [(1, 1, 1, 5), (1, 2, 2, 7)]


def test_percentiles_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", float(i // 3)) for i in range(300)] + [("b", 5.0), ("c", None)], "k string, v double")
    got = {(r[0], r[1]): r[3] for r in exact_percentiles(df, "k", "v", [0.5, 0.99, 1.0]).collect()}
    assert got == {("a", 0.5): 50.0, ("a", 0.99): 99.0, ("a", 1.0): 99.0, ("b", 0.5): 5.0, ("b", 0.99): 5.0, ("b", 1.0): 5.0}


def test_accepted_rows_are_anchored_on_accepted_ones(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 600, 2), (1, 1200, 3), (2, 5, 4)], "k long, s long, id long")
    assert {r["id"]: r["accepted"] for r in accepted_rows(df, ["k"], "s", "id", gap=900).collect()} == {1: True, 2: False, 3: True, 4: True}
    assert {r["id"]: r["accepted"] for r in accepted_rows(df, ["k"], "s", "id", cap=2, span=1200).collect()} == {1: True, 2: True, 3: True, 4: True}
    assert accepted_rows(df.limit(0), ["k"], "s", "id", gap=1).count() == 0


def test_streaks(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 2, 4, 5, 6)] + [None]
    df = spark.createDataFrame([("u", d) for d in days], "k string, d date")
    assert sorted(r["length"] for r in streaks(df, "k", "d").collect()) == [2, 3]


def test_diversified_fills_up(spark):
    df = spark.createDataFrame([("g", "x", i) for i in range(5)] + [("g", "y", 9)], "g string, t string, i long")
    got = diversified(df, "g", [F.col("i")], "t", 4, 2)
    assert [r["i"] for r in got.orderBy("place").collect()] == [0, 1, 9, 2]


def test_ledger(spark):
    df = spark.createDataFrame([("u", 5, 1), ("u", -7, 2), ("u", 3, 3), ("u", -8, 4), ("u", 5, 9)], "u string, d long, i long")
    assert [(r["granted"], r["balance"]) for r in guarded(df, "u", "d", ["i"]).orderBy("i").collect()] == [(True, 5), (False, 5), (True, 8), (True, 0), (True, 5)]
    assert rows(idempotent(df.select("u", "d", "i"), ["u", "d"], ["i"]))[-1] == ("u", 5, 1)
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long"), spark.createDataFrame([("y", 2), ("z", 3)], "k string, v long")
    assert rows(drift(a, b, "k", "v")) == [("x", 1, 0), ("z", 0, 3)]
    assert rows(changes(a, b, ["k"])) == [("x", "removed"), ("y", "kept"), ("z", "added")]


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, [0.0, 0.0], 2), (4, None, 2), (5, [1.0], 2)], "id long, v array<float>, g int")
    assert [(r["id"], round(r["score"], 6)) for r in cosine_top_k(df.filter("id = 0"), df, "id", "v", 5).orderBy("place").collect()] == [(1, 1.0), (2, 0.0)]
    assert {(r["g"], r["at"]): r["value"] for r in centroids(df, "g", "v", 2).collect()} == {(1, 0): 1.0, (1, 1): 0.0, (2, 0): 0.0, (2, 1): 1.0}


def test_filters_and_phrase(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n long, s string")
    assert rows(df.filter(filters({"not": {"s": "a"}})).select("n")) == [(2,), (3,)]
    assert rows(df.filter(filters({"s": None})).select("n")) == [(2,)]
    assert rows(df.filter(filters({("n", ".."): (2, 3), "s": ["a", "b"]})).select("n")) == [(3,)]
    assert spark.range(1).select(phrase(F.lit("One, two three"), "two three"), phrase(F.lit("two thr"), "two three")).first()[:] == (True, False)


def test_files(spark, tmp_path):
    (tmp_path / "e.json").write_text("\n".join(json.dumps(x) for x in [{"event_type": "view", "dwell_ms": 9_999_999}, {"event_type": "bad", "dwell_ms": 1}]))
    assert [r[:] for r in read_events_json(spark, str(tmp_path), "event_type string, dwell_ms long", ["view"]).collect()] == [("view", 3_600_000)]
    got = json_batches(spark.range(10).repartition(1), "id", 30, 3).collect()
    assert sum(r["n"] for r in got) == 10 and max(r["n"] for r in got) <= 3 and max(r["bytes"] for r in got) <= 30
    parts = balanced(spark.range(100).select((F.col("id") % 10).alias("k")), "k", 3).groupBy("k").agg(F.count_distinct("part").alias("n"))
    assert {r["n"] for r in parts.collect()} == {1}


def test_outbox_and_stream(spark, tmp_path):
    state = spark.createDataFrame([(1, 0), (2, 0)], "k long, seq long")
    queue = spark.createDataFrame([(1, 1, "delete"), (3, 2, "delete"), (3, 3, "upsert")], "k long, seq long, action string")
    assert rows(applied(state, queue, ["k"], "seq")) == [(2, 0), (3, 3)]
    queue.write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(queue.schema).parquet(str(tmp_path / "q"))
    for _ in range(2):  # the second run finds nothing new in the checkpoint
        drain(stream, str(tmp_path / "out"), ["k"], "seq", str(tmp_path / "cp")).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("k", "seq", "action")) == [(1, 1, "delete"), (3, 3, "upsert")]


def test_anchored_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("u", 1, at(0)), ("u", 2, at(600)), ("u", 3, at(1200)), ("v", 4, at(5))], "viewer string, id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = anchored_views(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "viewer", "ts", "id")
    stream.writeStream.format("memory").queryName("views").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["row"] for r in spark.table("views").collect()) == [1, 3, 4]


def test_tag_balance_against_a_stack(spark):
    import re

    from agoraspark.plans import registry

    got = {r["page_id"]: (r["orphans"], r["unclosed"]) for r in registry.queries()["txt_balance"](spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").filter("html is not null").collect()
    for page in pages:
        stack, orphans = [], 0
        for slash, name in re.findall(r"(?i)<(/?)(p|div|ul|li|table|tr|td|h1|h2|a)[ >]", page["html"]):
            name = name.lower()
            if not slash:
                stack.append(name)
            elif name in stack:
                while stack.pop() != name:
                    pass
            else:
                orphans += 1
        assert got[page["page_id"]] == (orphans, len(stack))
    assert len(got) == len(pages) > 0


def test_sqlite_in_ranges(spark, tmp_path):
    import sqlite3

    from agoraspark.sources.files import id_ranges, read_sqlite
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    path = tmp_path / "threads.db"
    with sqlite3.connect(path) as con:
        con.execute("create table threads (id integer primary key, title text)")
        con.executemany("insert into threads values (?, ?)", [(i * 3, f"t{i}") for i in range(500)])
        con.execute("create table none (id integer primary key, title text)")
    schema = StructType([StructField("id", LongType()), StructField("title", StringType())])
    got = read_sqlite(spark, str(path), "threads", "id", schema, 7)
    assert rows(got) == [(i * 3, f"t{i}") for i in range(500)]
    assert rows(read_sqlite(spark, str(path), "none", "id", schema)) == []
    assert id_ranges(-1, 9, 4) == [(-1, 1), (1, 4), (4, 6), (6, 9)] and id_ranges(4, 5, 3) == [(4, 5)]


def test_json_documents_and_requests(spark, tmp_path):
    import json

    from agoraspark.sources.files import read_events_json, read_json_document

    (tmp_path / "list.json").write_text(json.dumps([{"id": 1, "verdict": "guide"}, {"id": 2, "verdict": None}], indent=2))
    got = {r["id"]: r["verdict"] for r in read_json_document(spark, str(tmp_path / "list.json"), "id long, verdict string").collect()}
    assert got == {1: "guide", 2: None}
    lines = [json.dumps({"event_type": "view", "dwell_ms": 10**9, "read_pct": -5, "request": r, "place": i}) for r in "ab" for i in range(60 if r == "a" else 3)] + ["no json", json.dumps({"event_type": "other"})]
    (tmp_path / "events.json").write_text("\n".join(lines))
    kept = read_events_json(spark, str(tmp_path / "events.json"), "event_type string, dwell_ms long, read_pct long, request string, place long", ["view"], "request", "place")
    assert kept.count() == 53 and {(r["dwell_ms"], r["read_pct"]) for r in kept.collect()} == {(3_600_000, 0)}


def test_batches_run_over_arrow_batches(spark):
    from agoraspark.sources.files import json_batches

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = json_batches(spark.range(100).repartition(1), "id", 10_000, 25).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["n"] for r in got] == [25, 25, 25, 25] and [r["last"] for r in got] == [False, False, False, True]
    large = json_batches(spark.createDataFrame([("x" * 50,), ("y",)], "t string").repartition(1), "t", 20, 5).collect()
    assert [r["n"] for r in large] == [1, 1]


def test_windowed_counts_and_sent_marks(spark, tmp_path):
    import datetime as dt

    from agoraspark.streaming.state import drain, windowed_counts

    source = str(tmp_path / "in")
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (1, 2, 7, 8, 21, 40)]
    spark.createDataFrame([(t, "view" if i % 2 else "click", i) for i, t in enumerate(at)], "ts timestamp, kind string, id long").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, kind string, id long").parquet(source)
    counted = windowed_counts(stream, "ts", "kind", "10 minutes", "1 hour")
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("counted").collect()) == [1, 1, 2, 2]
    query = drain(stream.selectExpr("id", "kind", "id as seq"), str(tmp_path / "out"), ["kind"], "seq", str(tmp_path / "c2")).start()
    query.awaitTermination(120)
    assert {r["kind"]: r["seq"] for r in spark.read.parquet(str(tmp_path / "out" / "batch=0")).collect()} == {"click": 4, "view": 5}
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out-sent")).collect()) == list(range(6))


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, 0, 1), (None, 10, 2), (1, 0, 3), (None, 1000, 4)], "k long, s long, id long")
    assert {r["id"]: r["accepted"] for r in accepted_rows(df, ["k"], "s", "id", gap=900).collect()} == {1: True, 2: False, 3: True, 4: True}
    spent = spark.createDataFrame([(None, 5, 1), (None, -4, 2), (None, -4, 3), (2, -1, 4)], "k long, d long, id long")
    from agoraspark.operators.ledger import guarded

    assert {r["id"]: (r["granted"], r["balance"]) for r in guarded(spent, "k", "d", ["id"]).collect()} == {1: (True, 5), 2: (True, 1), 3: (False, 1), 4: (False, 0)}


def test_text_helpers(spark):
    from agoraspark.functions import text as T

    one = spark.range(1).select(T.slug(F.lit("Größe & Été!")).alias("s"), T.excerpt(F.lit("one two three four"), 9).alias("e"), T.excerpt(F.lit("short"), 9).alias("k"), T.excerpt(F.lit("a bcdefghijkl"), 9).alias("h")).first()
    assert tuple(one) == ("grosse-ete", "one two", "short", "a bcdefgh")
