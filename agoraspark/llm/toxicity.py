"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-case words, hashed to BITS bits. The score is the logistic function of a bias, one
weight per term and, for every pair of terms in the text, the product of their factor vectors; so that two terms can
say together what neither says alone. All terms of MIN_ROWS rows or more take part, on a bounded sample (SAMPLE_PER_CLASS
rows of either label in expectation, at most twice as many where ids repeat) of labelled rows.

Nothing is left out by what it says alone; penalties keep noise at zero instead. Weights are trained by
follow-the-regularised-leader with an L1 penalty, factors likewise with a penalty on the length of a term's vector. For a
term without evidence the penalty is DEVIATIONS times the deviation that its gradients would have by chance; for one with
evidence, alone or in a pair, it is L1. A pair has evidence if the rows that hold both terms differ from what the weights
alone predict by PAIR_DEVIATIONS deviations; sums over all pairs of the sample (of terms of
PAIR_ROWS rows or more; rarer pairs are left to descent) are kept in 2**PAIR_BITS buckets, and exactly for the pairs of buckets that stand out. The factors start from the
leading eigenvectors of the matrix of these pairs, as descent from a start at random rarely finds pairs among many terms.

Null and empty texts get the score of no terms. Rows without label, or with a null one, aren't learned from; of several
labels of one doc_id the greatest counts. Without labels of both kinds every score is the share of the kind there is,
0 if there is none. A score depends on the model and the text alone, so equal texts and repeated rows get equal scores in any
partitioning; a score of exactly one half is predicted as toxic. Texts are read whole however long. Rows without doc_id are
scored, but have no label. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from agoraspark.llm import textvec
from agoraspark.llm.common import class_sample, crc_fold, unit_hash

BITS = 18
FACTORS = 4
SAMPLE_PER_CLASS = 4000
EPOCHS, FACTOR_EPOCHS, BATCH = 40, 10, 32
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1.0, 0.05
DEVIATIONS = 4.0
MIN_ROWS = 3
PAIR_DEVIATIONS, PAIR_ROWS, PAIR_BITS, PAIR_BLOCK = 6.0, 40, 21, 1 << 20
START = 1e-3  # deviation of factors at the start


def terms(block: textvec.Block) -> tuple[np.ndarray, np.ndarray]:
    """Text index and term of each distinct term of each text, in order."""
    owner, _, hashed = textvec.words(block, textvec.word_map())
    keys = np.unique(owner.astype(np.uint64) << np.uint64(BITS) | hashed >> np.uint64(64 - BITS))
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _sampled(docs: DataFrame) -> DataFrame:
    """Label and terms of labelled rows (doc_id, toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for block in textvec.blocks(batch.column(2).to_pylist()):
                owner, term = terms(block)
                cuts = np.searchsorted(owner, np.arange(block.n + 1))
                packed = [term[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, block.n), batch.column(1).slice(first, block.n), pa.array(packed, pa.binary())], ["doc_id", "toxic", "terms"])
                first += block.n

    return docs.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, terms binary")


def frequent(rows: list[np.ndarray]) -> np.ndarray:
    """The terms of MIN_ROWS rows or more, in order."""
    known, counts = np.unique(np.concatenate(rows), return_counts=True)
    return known[counts >= MIN_ROWS]


def associated(rows: list[np.ndarray], label: np.ndarray, size: int) -> np.ndarray:
    """Which terms 0..size-1 differ in frequency between the labels by DEVIATIONS deviations."""
    owner, at = np.repeat(label, [len(r) for r in rows]), np.concatenate(rows)
    counts = np.stack([np.bincount(at[owner == y], minlength=size) for y in (0, 1)]).astype(float)
    n = np.bincount(label, minlength=2)
    share = counts.sum(axis=0) / n.sum()
    spread = np.sqrt(share * (1 - share) * (1 / n[1] + 1 / n[0]))
    return np.abs(counts[1] / n[1] - counts[0] / n[0]) > DEVIATIONS * np.maximum(spread, 1e-12)


def places(known: np.ndarray, terms_: np.ndarray) -> np.ndarray:
    """Where each term stands among the known ones, -1 for others."""
    if not len(known):
        return np.full(len(terms_), -1)
    at = np.minimum(np.searchsorted(known, terms_), len(known) - 1)
    return np.where(known[at] == terms_, at, -1)


def logistic(y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


class Rows:
    """Some rows of terms laid end to end."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.at = np.concatenate(rows)
        self.owner = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each row's terms of values by term (one column or more)."""
        if values.ndim == 1:
            return np.bincount(self.owner, values[self.at], self.n)
        return np.stack([np.bincount(self.owner, values[self.at, k], self.n) for k in range(values.shape[1])], 1)

    def predict(self, bias: float, w: np.ndarray, v: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Scores before the logistic function, and the rows' sums of factors."""
        y = bias + self.sums(w)
        if v is None:
            return y, None
        s = self.sums(v)
        own = v[self.at]
        return y + 0.5 * ((s * s).sum(axis=1) - np.bincount(self.owner, (own * own).sum(axis=1), self.n)), s


@dataclass
class State:
    """What follow-the-regularised-leader knows of the weights, to go on from."""

    w: np.ndarray
    z: np.ndarray
    n: np.ndarray
    chance: np.ndarray
    bias: float = 0.0
    seen: float = 1e-6
    epochs: int = 0


def train(rows: list[np.ndarray], label: np.ndarray, evident: np.ndarray, epochs: int, state: State | None = None, start: np.ndarray | None = None) -> tuple[State, np.ndarray | None]:
    """Bias and weights, and factors if there is a start of them, BATCH rows at a time in a fixed order. evident: terms of penalty L1."""
    size = len(evident)
    state = state or State(*(np.zeros(size) for _ in range(4)))
    w, z, n, chance, bias, seen = state.w, state.z, state.n, state.chance, state.bias, state.seen
    v = None if start is None else start.copy()
    if v is not None:
        zv, nv, chance_v = np.zeros(v.shape), np.zeros(v.shape), np.zeros(size)
    for epoch in range(state.epochs, state.epochs + epochs):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for first in range(0, len(rows), BATCH):
            chosen = order[first : first + BATCH]
            part = Rows([rows[i] for i in chosen])
            y, s = part.predict(bias, w, v)
            p = logistic(y)
            slip, variance = p - label[chosen], p * (1 - p)
            u, back = np.unique(part.at, return_inverse=True)
            by_term = lambda values, u=u, back=back: np.bincount(back, values, len(u))
            own = part.owner
            old, n[u] = n[u], n[u] + by_term((slip * slip)[own])
            chance[u] += by_term(variance[own])
            z[u] += by_term(slip[own]) - (np.sqrt(n[u]) - np.sqrt(old)) / ALPHA * w[u]
            limit = np.where(evident[u], L1, np.maximum(L1, DEVIATIONS * np.sqrt(chance[u] * (epoch + 1))))
            w[u] = -np.sign(z[u]) * np.maximum(0, np.abs(z[u]) - limit) / ((BETA + np.sqrt(n[u])) / ALPHA + L2)
            if v is not None:
                others = s[own] - v[part.at]
                g = np.stack([by_term(slip[own] * others[:, k]) for k in range(FACTORS)], 1)
                old = nv[u]
                nv[u] = old + np.stack([by_term((slip[own] * others[:, k]) ** 2) for k in range(FACTORS)], 1)
                chance_v[u] += by_term(variance[own] * (others * others).sum(axis=1))
                zv[u] += g - (np.sqrt(nv[u]) - np.sqrt(old)) / ALPHA * (v[u] - start[u])
                length = np.sqrt((zv[u] ** 2).sum(axis=1))
                limit = np.where(evident[u], L1, np.maximum(L1, DEVIATIONS * np.sqrt(chance_v[u] * (epoch - state.epochs + 1))))
                kept = np.maximum(0, 1 - limit / np.maximum(length, 1e-12))
                v[u] = start[u] - zv[u] * kept[:, None] / ((BETA + np.sqrt(nv[u])) / ALPHA + L2)
            seen += slip.sum() ** 2
            bias -= 0.3 * slip.sum() / np.sqrt(seen)
    return State(w, z, n, chance, bias, seen, state.epochs + epochs), v


def evident_pairs(rows: list[np.ndarray], label: np.ndarray, p: np.ndarray, size: int) -> list[tuple[int, int, float]]:
    """Pairs of terms whose rows differ from the predictions p by PAIR_DEVIATIONS deviations: both terms, and the step that mends it."""
    counts = np.bincount(np.concatenate(rows), minlength=size)
    slips, variances = label - p, p * (1 - p)
    used = [r[counts[r] >= PAIR_ROWS] for r in rows]

    def pairs(terms_: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Buckets of all pairs, PAIR_BLOCK or so at a time: a place, which of the pairs of the terms from there on are new, their buckets."""
        first, second = terms_.astype(np.uint32) * np.uint32(0x9E3779B1), terms_.astype(np.uint32)
        step = max(1, PAIR_BLOCK // max(1, len(terms_)))
        for i in range(0, len(terms_), step):
            bucket = (first[i : i + step, None] ^ second[None, i:]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - PAIR_BITS)
            fresh = np.arange(bucket.shape[1])[None, :] > np.arange(len(bucket))[:, None]
            yield i, fresh, bucket[fresh]

    total, spread = np.zeros(1 << PAIR_BITS), np.zeros(1 << PAIR_BITS)
    held: list[tuple[np.ndarray, float, float]] = []

    def pour() -> None:
        if held:
            where, sizes = np.concatenate([b for b, _, _ in held]), [len(b) for b, _, _ in held]
            for into, k in ((total, 1), (spread, 2)):
                into += np.bincount(where, np.repeat([x[k] for x in held], sizes), len(into))
            held.clear()

    waiting = 0
    for terms_, slip, variance in zip(used, slips, variances, strict=True):
        for _, _, bucket in pairs(terms_):
            held.append((bucket, slip, variance))
            waiting += len(bucket)
            if waiting >= PAIR_BLOCK:
                pour()
                waiting = 0
    pour()
    # opposite pairs may hide each other in a bucket, which 2**PAIR_BITS buckets make rare
    hot = np.abs(total) >= PAIR_DEVIATIONS * np.sqrt(spread + 1)
    exact: dict[tuple[int, int], list[float]] = {}
    for terms_, slip, variance in zip(used if hot.any() else [], slips, variances, strict=False):
        for i, fresh, bucket in pairs(terms_):
            at = np.flatnonzero(hot[bucket])
            a, b = (x[at] + i for x in np.nonzero(fresh)) if len(at) else (at, at)
            for pair in zip(terms_[a].tolist(), terms_[b].tolist(), strict=True):
                sums = exact.setdefault(pair, [0.0, 0.0])
                sums[0] += slip
                sums[1] += variance
    return [(a, b, t / s) for (a, b), (t, s) in exact.items() if abs(t) >= PAIR_DEVIATIONS * np.sqrt(s + 1)]


def start_of_factors(pairs: list[tuple[int, int, float]], size: int) -> np.ndarray:
    """Factors whose products come near the pairs' steps: leading eigenvectors of their matrix, made positive by its diagonal."""
    v = np.random.default_rng(5).normal(0, START, (size, FACTORS))
    if pairs:
        ids, place = np.unique([p[:2] for p in pairs], return_inverse=True)
        place = place.reshape(-1, 2)
        steps = np.zeros((len(ids), len(ids)))
        steps[place[:, 0], place[:, 1]] = np.clip([p[2] for p in pairs], -4, 4)
        steps += steps.T
        steps[np.diag_indices(len(ids))] = np.abs(steps).sum(axis=1)
        values, vectors = np.linalg.eigh(steps)
        values, vectors = values[::-1][:FACTORS], vectors[:, ::-1][:, :FACTORS]
        v[ids, : len(values)] += vectors * np.sqrt(np.maximum(values, 0))
    return v


def fit_machine(rows: list[np.ndarray], label: np.ndarray, size: int, factors: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors over terms 0..size-1: weights alone first, then with factors from the pairs that they miss."""
    evident = associated(rows, label, size)
    linear, _ = train(rows, label, evident, EPOCHS)
    if not factors:
        return linear.bias, linear.w, np.zeros((size, FACTORS))
    p = np.concatenate([logistic(Rows(rows[i : i + 256]).predict(linear.bias, linear.w, None)[0]) for i in range(0, len(rows), 256)])
    pairs = evident_pairs(rows, label, np.clip(p, 0.02, 0.98), size)
    evident[[t for pair in pairs for t in pair[:2]]] = True
    whole, v = train(rows, label, evident, FACTOR_EPOCHS, linear, start_of_factors(pairs, size))
    return whole.bias, whole.w, v


def _marked(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0 or 1) of labels, one row an id."""
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    return marked.withColumn("toxic", (F.col("toxic") > 0).cast("int"))


def sampled_rows(docs: DataFrame, marked: DataFrame, per_class: int) -> list[Row]:
    """doc_id, toxic and terms of a sample of the labelled rows, 2 * per_class of either label in expectation at most, in order.

    Ids are drawn among the labels first, so that what is broadcast is bounded and no text is shuffled. If these ids have more
    rows than that bound, as ids that repeat do, rows are drawn among them by id and text. Rows that repeat count once.
    """
    chosen = F.broadcast(class_sample(marked, "toxic", "doc_id", per_class))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    apart = texts.join(chosen, "doc_id").select("toxic", "doc_id", F.xxhash64("text").alias("h")).distinct()
    share = F.lit(0.0)
    for value, n in apart.groupBy("toxic").count().collect():
        share = F.when(F.col("toxic") == value, min(1.0, 2 * per_class / n)).otherwise(share)
    drawn = texts.join(chosen, "doc_id").filter(unit_hash(F.lit("rows"), "doc_id", "text") < share)
    return sorted(_sampled(drawn).distinct().collect(), key=lambda r: (r["doc_id"], r["terms"]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, factors: bool = True) -> dict:
    """The model learned from docs (doc_id, text) and labels (doc_id, toxic); without factors a linear one."""
    marked = _marked(labels)
    totals = {0: 0, 1: 0}
    for value, n in marked.groupBy("toxic").count().collect():
        totals[value] = n
    found = sampled_rows(docs, marked, per_class)
    label = np.array([r["toxic"] for r in found], int)
    rows = [np.frombuffer(r["terms"], np.uint32).astype(np.int64) for r in found]
    kinds = np.bincount(label, minlength=2)
    if not kinds.all():
        return {"known": np.zeros(0, int), "w": np.zeros(0), "v": np.zeros((0, FACTORS)), "bias": 30.0 if kinds[1] else -30.0}
    known = frequent(rows)
    bias, w, v = fit_machine([(at := places(known, r))[at >= 0] for r in rows], label, len(known), factors)
    # the sample evens the labels out; the bias is moved back to their shares among all labels
    bias += float(np.log(totals[1] / totals[0]) - np.log(kinds[1] / kinds[0]))
    return {"known": known, "w": w, "v": v, "bias": bias}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score for every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model["known"], model["w"], model["v"], model["bias"]))  # 2**BITS terms at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w, v, bias = shared.value
        squares = (v * v).sum(axis=1)
        for batch in batches:
            out = []
            for block in textvec.blocks(batch.column(1).to_pylist()):
                owner, term = terms(block)
                at = places(known, term)
                owner, at = owner[at >= 0], at[at >= 0]
                y = bias + np.bincount(owner, w[at], block.n) - 0.5 * np.bincount(owner, squares[at], block.n)
                for f in range(v.shape[1]):
                    y += 0.5 * np.bincount(owner, v[at, f], block.n) ** 2
                out.append(1 / (1 + np.exp(-np.clip(y, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column | str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5."""
    return crc_fold(doc_id, 5) == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; learned from the labels that aren't held out."""
    model = fit(docs, labels.filter(~held_out("doc_id")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
