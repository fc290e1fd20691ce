"""The audit of filters against orders that are applied one after the other, row by row."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from agoraspark.llm import filter_audit

DATA = "/root/testdata/sf0.001"


def plain_flags(rows):
    """Failure conditions of rows (doc_id, text), each by itself."""
    least = {}
    for d, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, text in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        capitals = sum("A" <= c <= "Z" for c in text)
        yield {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * capitals > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": d is not None and d > least[text]}


def plain_audit(docs, labels):
    """docs: doc_id, text, lang. labels: doc_id, quality, toxic."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    flags = list(plain_flags([r[:2] for r in docs]))
    out, total = [], {}
    for part in {r[2] or "" for r in docs}:
        own = [(r[0], f) for r, f in zip(docs, flags, strict=True) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, x in enumerate(order, 1):
                here = [r for r in left if r[1][x]]
                kept = [r for r in left if not r[1][x]]
                total[part, x] = total.get((part, x), 0) + len(here)
                unique = sum(f[x] and sum(f.values()) == 1 for _, f in own)
                out.append((part, "".join(order), step, len(kept), len(here), sum(r[1][x] for r in gone), unique, sum(r[0] in good for r in here), sum(r[0] in toxic for r in here), x))
                left, gone = kept, gone + here
    return sorted((*r[:-1], total[r[0], r[-1]]) for r in out)


def got(docs, labels):
    found = filter_audit.audit(filter_audit.failing(docs, labels))
    return sorted(map(tuple, found.collect()))


def test_audit_against_orders_applied_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    want = plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    assert got(docs, labels) == want and len(want) == 4 * 600


def test_audit_of_odd_rows(spark, odd, empty):
    copies = [(i, "$ COPY of one text", "en", "x", 1, "h", 2) for i in (50, 50, 51, 52, None)] + [(60, "only\x0bone\x0cword\x1chere", "", "y", 1, "h", 2)]
    docs = odd.unionByName(spark.createDataFrame(copies, odd.schema))
    labels = spark.createDataFrame([(50, 1, 0, 9), (50, 0, 1, 9), (51, 1, None, 9), (None, 1, 1, 9), (5, None, 1, 9), (1, 1, 1, 9)], "doc_id long, quality int, toxic int, part int")
    assert got(docs, labels) == plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [tuple(r)[:3] for r in labels.collect()])
    assert got(empty, labels) == [] and len(got(docs, labels.limit(0))) == 2 * 600


@pytest.mark.parametrize("letters", ["AB", "DAC"])
def test_states_are_made_once(spark, letters):
    rows = spark.createDataFrame([("p", True, True, False, True, True, False), ("p", False, True, True, False, False, True), ("q", False, False, False, False, True, True)], "part string, A boolean, B boolean, C boolean, D boolean, good boolean, toxic boolean")
    edges = filter_audit.walk(rows, letters).collect()
    assert len({(r["state"], r["letter"], r["part"]) for r in edges}) == len(edges)
    assert {r["state"] for r in edges} <= set(range((1 << len(letters)) - 1))
    found = filter_audit.audit(rows, letters).collect()
    assert len(found) == 2 * len(list(permutations(letters))) * len(letters)
    for r in found:
        order, flags = r["filter_order"], [x.asDict() for x in rows.filter(F.col("part") == r["part"]).collect()]
        before = [x for x in flags if not any(x[c] for c in order[: r["step"] - 1])]
        assert r["removed"] == sum(x[order[r["step"] - 1]] for x in before) and r["kept"] == len(before) - r["removed"]
