"""The positional index against scans of the documents, and misspelt words and synonyms against plain code."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from agoraspark.operators import index as ix
from agoraspark.operators import search, synonyms

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    text = F.lower(F.regexp_replace("text", "[0-9]", ""))
    more = spark.createDataFrame([(900, ""), (901, None), (902, "the the of the"), (903, "THE, of? the!")], "doc_id long, text string")
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", text.alias("text")).unionByName(more)


@pytest.fixture(scope="module")
def index(docs):
    return ix.build(docs.withColumn("title", F.substring("text", 1, 80)), "doc_id", ["title", "text"])


def test_scores_equal_those_of_a_scan(docs, index):
    asked = ["the", "of", "une", "nowhere"]
    want = {r["doc_id"]: r for r in search.bm25(docs.filter("text is not null"), "doc_id", "text", asked).collect()}
    got = {r["id"]: r for r in ix.scores(index, asked, {"text": 1.0}).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for i, r in got.items():
        assert r["matched"] == want[i]["matched"] and math.isclose(r["score"], want[i]["score"], rel_tol=1e-9)


def test_only_the_folders_of_the_words_are_read(index):
    plan = index.postings(["the"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=|INSET)", plan) and re.search(r"PushedFilters: \[[^\]]*word", plan), plan[-900:]
    every = index.table("postings")
    assert index.postings(["the"]).select(F.input_file_name()).distinct().count() < every.select(F.input_file_name()).distinct().count() / 4


@pytest.mark.parametrize(("asked", "k"), [(["the", "une", "der"], 5), (["the"], 10), (["nowhere"], 3), (["of", "the"], 1000)])
def test_blocks_are_skipped_and_the_best_are_the_same(index, monkeypatch, asked, k):
    weights = {"title": 3.0, "text": 1.0}
    want = ix.scores(index, asked, weights).orderBy(F.desc("score"), "id").limit(k).collect()
    best, counts = ix.top(index, asked, weights, k)
    got = best.collect()
    assert [r["id"] for r in got] == [r["id"] for r in want] and counts["scored"] <= counts["blocks"]
    n = ix.scores(index, asked, weights).count()
    assert ix.total_up_to(index, asked, 7) == (min(n, 7), n > 7)


def test_blocks_are_skipped_where_few_are_good(spark, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 4)
    rows = [(i, "common " + ("rare " * 9 if i < 8 else "word " * 9)) for i in range(400)]
    built = ix.build(spark.createDataFrame(rows, "id long, text string"), "id", ["text"])
    best, counts = ix.top(built, ["common", "rare"], {"text": 1.0}, 4)
    assert [r["id"] for r in best.collect()] == [0, 1, 2, 3]
    assert counts["blocks"] == 100 and counts["scored"] <= 4


def test_phrases(docs, index):
    for asked in (["of", "the"], ["the", "the"], ["the", "of", "the"], ["nowhere", "the"]):
        want = {r["doc_id"] for r in docs.filter(search.phrase(F.col("text"), " ".join(asked))).collect()}
        got = {r["id"]: r["starts"] for r in ix.phrase(index, asked, "text").collect()}
        assert got.keys() == want
        for r in docs.filter(F.col("doc_id").isin(list(want)[:5])).collect():
            w = [x for x in re.split(r"[\W_]+", r["text"].lower()) if x]
            assert sorted(got[r["doc_id"]]) == [i for i in range(len(w)) if w[i : i + len(asked)] == asked]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_misspelt_words_equal_edit_distance(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 13)))
    vocabulary, asked = sorted({word() for _ in range(400)} | {"12345", "1234"}), sorted({word() for _ in range(120)} | {"12345"})
    got = {(r["asked"], r["word"]): r["edits"] for r in ix.near_words(spark.createDataFrame([(w,) for w in vocabulary], "word string"), spark.createDataFrame([(w,) for w in asked * 2], "asked string")).collect()}
    most = lambda w: 0 if len(w) < 4 or w.isdigit() else 1 if len(w) < 8 else 2
    want = {(a, w): d for a in asked for w in vocabulary if (d := levenshtein(a, w)) <= most(a)}
    assert got == want and len(want) > 200


def test_rules_in_turn(docs, index):
    asked, fields = ["the", "herean", "of"], ["title", "text"]
    score = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("value"))
    got = [tuple(r) for r in ix.ranked(index, asked, fields, 40, score=score).select("id", "words", "typo", "proximity", "attribute", "exactness", "score").collect()]
    want = []
    for r in docs.filter("text is not null").collect():
        split = [[w for w in re.split(r"[^\w]|_", t.lower()) if w] for t in (r["text"][:80], r["text"])]
        at, typo, exact, attribute = {}, 0, 0, 9
        for j, a in enumerate(asked):
            most = 0 if len(a) < 4 else 1
            hits = [(f, i, d) for f, w in enumerate(split) for i, x in enumerate(w) if abs(len(x) - len(a)) <= most and (d := levenshtein(a, x)) <= most]
            if hits:
                at[j], best = hits, min(d for _, _, d in hits)
                typo, exact, attribute = typo + best, exact + (best == 0), min(attribute, *(f for f, _, _ in hits))
        if at:
            near = sum(min([8] + [abs(x - y) for f, x, _ in at.get(j, []) for g, y, _ in at.get(j + 1, []) if f == g]) for j in range(2))
            want.append((3 - len(at), typo, near, attribute, 3 - exact, -(r["doc_id"] % 5), r["doc_id"]))
    want = [(i, w, t, p, a, e, -s) for w, t, p, a, e, s, i in sorted(want)[:40]]
    assert got == want


def test_synonyms_longest_first(spark):
    entries = {"car": ["car", "motor car", "four wheel drive car"], "drive": ["drive"], "cpp": ["c++", "see plus plus"], "net": [".net core"]}
    trie = synonyms.compiled(entries)
    texts = ["A four wheel drive car and a drive", "motor car C++ c+ see plus plus", "four wheel drive", "", None, ".NET core x.net"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", synonyms.concepts(synonyms.tokens(F.col("t"), [".net"], "+"), trie).alias("m"))
    got = {r["i"]: [(m["concept"], m["begin"], m["length"]) for m in r["m"] or []] for r in df.collect()}
    assert got == {0: [("car", 1, 4), ("drive", 7, 1)], 1: [("car", 0, 2), ("cpp", 2, 1), ("cpp", 4, 3)], 2: [("drive", 2, 1)], 3: [], 4: [], 5: [("net", 0, 2)]}
    with pytest.raises(ValueError, match="two concepts"):
        synonyms.compiled({"a": ["x y"], "b": ["x y"]})


def test_synonyms_against_every_split():
    rng = random.Random(7)
    forms = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(12)}
    entries = {f: [" ".join(f)] for f in forms}
    trie = synonyms.compiled(entries)
    for _ in range(300):
        w = [rng.choice("abcd") for _ in range(rng.randrange(0, 20))]
        want, i = [], 0
        while i < len(w):
            n = max((n for n in range(1, 5) if "".join(w[i : i + n]) in forms and i + n <= len(w)), default=0)
            want += [("".join(w[i : i + n]), i, n)] if n else []
            i += n or 1
        assert synonyms.found(trie, w) == want


def test_counts_of_the_index(docs, index):
    words = Counter(w for r in docs.filter("text is not null").collect() for w in re.split(r"[\W_]+", r["text"].lower()) if w)
    got = {r["word"]: r["n"] for r in index.table("postings").filter("field = 'text' and word <> ''").groupBy("word").agg(F.sum("tf").alias("n")).collect()}
    assert got == words and index.n == docs.filter("text is not null").count()


def test_no_posting_is_shuffled_and_segments_are_bounded(spark, docs, index, monkeypatch):
    """F3 to F8, F10 to F12: postings are written where they are made, in segments whose size doesn't change what is found."""
    rows = ix._segments(docs, "doc_id", ["text"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    monkeypatch.setattr(ix, "SEGMENT", 3000)
    small = ix.build(docs.withColumn("title", F.substring("text", 1, 80)), "doc_id", ["title", "text"])
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    for name in ("vocabulary", "postings"):
        listed = lambda i, name=name: sorted(map(str, i.table(name).collect()))
        assert listed(small) == listed(index)
    assert small.n == index.n and small.means == pytest.approx(index.means)
    stored = lambda i: spark.read.parquet(f"{i.folder}/postings").filter("bucket >= 0").selectExpr("input_file_name()", "field", "aggregate(postings, 0, (s, p) -> s + p.tf) AS n", "postings").collect()
    assert len(stored(small)) > len(stored(index))
    assert [r["id"] for r in ix.top(small, ["the", "une"], {"title": 3.0, "text": 1.0}, 9)[0].collect()] == [r["id"] for r in ix.top(index, ["the", "une"], {"title": 3.0, "text": 1.0}, 9)[0].collect()]


def test_few_words_become_objects_at_a_time():
    """rows are cut by their words, and the pieces give what the whole gives."""
    import pyarrow as pa

    trie = synonyms.compiled({"ab": ["a b"], "c": ["c"]})
    rows = [["a", "b", "c"] * 20_000, None, [], *([["c", "a", "b"] * 100] * 700), ["a"]]
    pieces = list(synonyms._cut(pa.array(rows, pa.list_(pa.string()))))
    assert sum(map(len, pieces)) == len(rows) and max(len(p.flatten()) for p in pieces) <= synonyms.WORDS and len(pieces) > 3
    got = pa.concat_arrays([synonyms._matches(trie, p.to_pylist()) for p in pieces]).to_pylist()
    assert got == [[{"concept": c, "begin": i, "length": n} for c, i, n in synonyms.found(trie, w or [])] for w in rows]
