"""The trained models against plain forms of the same steps, and ties at one half."""

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from agoraspark.llm import langid, textvec, toxicity, weak_quality


def test_regularised_leader_against_a_plain_one():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 50, 6)).astype(np.int32), None) for _ in range(30)]
    rows = [(at, rng.random(len(at))) for at, _ in rows]
    target = rng.integers(0, 3, 30)
    w, bias = langid.train_ftrl(rows, target, 3)
    z, n, b, seen = defaultdict(float), defaultdict(float), [0.0] * 3, [1e-8] * 3

    def weight(i, c):
        if abs(z[i, c]) <= langid.L1:
            return 0.0
        return (math.copysign(langid.L1, z[i, c]) - z[i, c]) / ((langid.BETA + math.sqrt(n[i, c])) / langid.ALPHA + langid.L2)

    for epoch in range(langid.EPOCHS):
        for r in np.random.default_rng(epoch).permutation(30):
            at, x = rows[r]
            logits = [b[c] + sum(v * weight(i, c) for i, v in zip(at, x, strict=True)) for c in range(3)]
            top = max(logits)
            total = sum(math.exp(v - top) for v in logits)
            slips = [math.exp(logits[c] - top) / total - (c == target[r]) for c in range(3)]
            old = {(i, c): weight(i, c) for i in at for c in range(3)}
            for i, v in zip(at, x, strict=True):
                for c in range(3):
                    g = v * slips[c]
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / langid.ALPHA * old[i, c]
                    n[i, c] += g * g
            for c in range(3):
                seen[c] += slips[c] ** 2
                b[c] -= 0.1 * slips[c] / math.sqrt(seen[c])
    assert np.allclose(bias, b, atol=1e-9)
    assert all(math.isclose(w[i, c], weight(i, c), abs_tol=1e-9) for i in range(50) for c in range(3)) and (w != 0).any() and not w[50:].any()


def test_factor_machine_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    texts = ["one two three two", "three four", "one", "", None, "unknown words", "one two three four five six seven"]
    known = np.unique(toxicity.terms(next(iter(textvec.blocks([" ".join(t for t in texts if t)]))))[1])[:8]
    model = {"known": known, "w": rng.normal(size=len(known)), "v": rng.normal(size=(len(known), toxicity.FACTORS)), "bias": -0.3}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(texts):
        own = toxicity.terms(next(iter(textvec.blocks([text]))))[1].tolist()
        at = [known.tolist().index(t) for t in own if t in known]
        y = model["bias"] + sum(model["w"][a] for a in at) + sum(model["v"][a] @ model["v"][b] for k, a in enumerate(at) for b in at[k + 1 :])
        assert math.isclose(got[i], 1 / (1 + math.exp(-y)), rel_tol=1e-9)
    assert {r["score"] for r in toxicity.score(docs.filter("doc_id in (3, 4)"), model | {"bias": 0.0}).collect()} == {0.5}
    even = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    pair = spark.createDataFrame([(1, "same words"), (2, "same words"), (5, "")], "doc_id long, text string")
    scored = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.toxicity(pair, even).collect()}
    assert scored[1] == scored[2] == (0.5, 1)  # one half counts as toxic


def test_expectation_maximisation_against_a_plain_one():
    rng = random.Random(5)
    labellers = len(weak_quality.LABELLERS)
    patterns = sorted({"".join(rng.choice("012") for _ in range(labellers)) for _ in range(60)})
    counted = [(p, rng.randrange(1, 40)) for p in patterns]
    got, rates, prior = weak_quality.fit_labellers(counted)
    good, bad, none = (str(x) for x in (weak_quality.GOOD, weak_quality.BAD, weak_quality.NONE))
    post = []
    for p, _ in counted:
        start = (p.count(good) + 1) / (p.count(good) + p.count(bad) + 2) - 0.4 * (p.count(bad) >= 2)
        post.append(min(0.98, max(0.02, start)))
    for _ in range(weak_quality.ROUNDS):
        total = sum(n for _, n in counted)
        share = min(0.99, max(0.01, sum(n * x for (_, n), x in zip(counted, post, strict=True)) / total))
        rate = {}
        for kind in (True, False):
            for j in range(labellers):
                tally = {v: 1 + sum(n * (x if kind else 1 - x) for (p, n), x in zip(counted, post, strict=True) if p[j] == v) for v in (good, bad)}
                rate |= {(kind, j, v): t / sum(tally.values()) for v, t in tally.items()} | {(kind, j, none): 1.0}
        odds = [math.log(1 - share) - math.log(share) + sum(math.log(rate[False, j, v]) - math.log(rate[True, j, v]) for j, v in enumerate(p)) for p, _ in counted]
        post = [1 / (1 + math.exp(min(30, max(-30, o)))) for o in odds]
    assert all(math.isclose(got[p], min(0.99, max(0.01, x)), abs_tol=1e-9) for (p, _), x in zip(counted, post, strict=True))
    assert math.isclose(prior, share, abs_tol=1e-9)
    assert weak_quality.fit_labellers([])[2] == 0.5
    # without votes both classes are as likely as the prior; of a tie one half is kept
    assert weak_quality.fit_labellers([(none * labellers, 7)])[0] == {none * labellers: 0.5}
