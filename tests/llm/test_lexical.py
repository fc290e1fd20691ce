"""Ranked search against a plain scoring of every document, whatever the shards, and on odd input."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from agoraspark.llm import lexical

DATA = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall(lexical.TERM, (text or "").translate(ASCII_LOWER))


def plain(docs, items, k):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(docs, items, k=20):
    return sorted(map(tuple, lexical.search(lexical.build_index(docs), items, k).collect()), key=str)


def rows(df):
    return [(r[0], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("tokens", [1, 5000, 1 << 21])
def test_search_against_plain_scores(spark, monkeypatch, tokens):
    monkeypatch.setattr(lexical, "SHARD_TOKENS", tokens)
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    if tokens == 1:
        docs = docs.repartition(3)
    assert got(docs, items) == plain(rows(docs), rows(items), 20)


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lexical, "SLICE", 7)
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet").limit(80), spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert got(docs, items, 3) == plain(rows(docs), rows(items), 3)


def test_odd_rows_and_ties(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, "the CAT", 1), (1, "the CAT", 2), (1, "river stones", 1), (2, None, 1), (3, "", 1), (None, "row without id", 1), (4, "日本語 ünï", 1), (5, "nothing-known", 1), (6, "the the the", 1)],
        "item_id long, text string, score int",
    )
    ties = spark.createDataFrame([(i % 50, "equal words of a group", "en", "x", 1, "h", 2) for i in range(100)] + [(None, "equal words of a group", "en", "x", 1, "h", 2)] * 30, odd.schema)
    asked = rows(items)
    for docs in (odd, ties, odd.unionByName(ties)):
        assert got(docs, items) == plain(rows(docs), asked, 20)
    more = items.unionByName(spark.createDataFrame([(9, "equal group", 1)], items.schema))
    found = got(ties, more)
    assert found == plain(rows(ties), rows(more), 20) and len([r for r in found if r[0] == 9]) in (0, 20)
    assert got(empty, items) == [] and got(odd, items.limit(0)) == []


def test_ties_at_the_last_place():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        scores, ids, missing = rng.integers(1, 5, n), rng.permutation(n), rng.random(n) < 0.2
        want = sorted(range(n), key=lambda i: (-scores[i], missing[i], ids[i]))[:7]
        assert lexical.best(scores, ids, missing, 7).tolist() == want
