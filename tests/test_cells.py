"""Searches over cells against a comparison with every vector."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agoraspark.operators import cells


def clustered(rng, n, groups, spread):
    centres = rng.normal(size=(groups, 16))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 16))


def frame(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(range(len(v)) if ids is None else ids, v, strict=True)], "id long, v array<double>")


def plain(q, v, k, floor, skip):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(v).T, 12)
    out = {}
    for i, own in enumerate(scores):
        at = [j for j in range(len(v)) if own[j] >= floor and j not in skip[i]]
        out[i] = sorted(at, key=lambda j: (-own[j], j))[:k]
    return out


@pytest.mark.parametrize(("spread", "group"), [(0.05, 20_000), (1.5, 60)])
def test_search_is_exact(spark, monkeypatch, spread, group):
    monkeypatch.setattr(cells, "GROUP_ROWS", group)
    monkeypatch.setattr(cells, "QUERY_ROWS", group // 4)
    rng = np.random.default_rng(4)
    v = clustered(rng, 900, 12, spread)
    v[100:110] = v[7]  # ties
    held = cells.build(frame(spark, v), "id", "v")
    q = np.concatenate([v[:30], clustered(rng, 20, 12, spread), -v[:3]])
    skip = [list(range(i, i + 5)) if i < 30 else [] for i in range(len(q))]
    queries = spark.createDataFrame([(i, [float(x) for x in row], s) for i, (row, s) in enumerate(zip(q, skip, strict=True))], "query long, q array<double>, skip array<long>")
    for k, floor in ((5, -1.0), (12, 0.6), (2000, 0.9)):
        report = {}
        got = {}
        for r in cells.search(held, queries, k, floor, report).orderBy("query", "place").collect():
            got.setdefault(r["query"], []).append(r["id"])
        assert {i: x for i, x in plain(q, v, k, floor, skip).items() if x} == got
        assert report["share"] <= 1 and (spread > 1 or k > 100 or report["share"] < 0.5)
    close = {}
    for r in cells.within(held, queries, 0.8).collect():
        close.setdefault(r["query"], set()).add(r["id"])
    assert {i: set(x) for i, x in plain(q, v, 10**6, 0.8, skip).items() if x} == close


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [-1.0, 0.0]), (None, [1.0, 1.0]), (6, [2.0, 0.0])], "id long, v array<double>")
    held = cells.build(rows, "id", "v")
    asked = spark.createDataFrame([(0, [3.0, 0.0]), (1, None), (2, [1.0]), (3, [0.0, 0.0])], "query long, q array<double>")
    assert [tuple(r) for r in cells.search(held, asked, 2).orderBy("place").collect()] == [(0, 1, 1.0, 1), (0, 6, 1.0, 2)]
    assert cells.build(rows.limit(0), "id", "v") is None
    assert cells.search(held, asked.limit(0), 2).count() == 0


def test_probes_of_a_few_queries_at_a_time():
    """what is held of probes doesn't grow with the batch of queries, though each may meet every cell."""
    batches = [pa.RecordBatch.from_pydict({"query": list(range(n))}) for n in (1000, 0, 5)]
    few = list(cells._few(iter(batches)))
    assert max(b.num_rows for b in few) == cells.PROBED <= 100
    assert [x for b in few for x in b.column(0).to_pylist()] == [*range(1000), *range(5)]
