"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are reduced to lower-case letters with one space wherever anything else stands; n-grams of one to three code
points are hashed to 2**BITS buckets. Document frequencies are counted over all documents that may be learned from.
The regression is trained with follow-the-regularised-leader (proximal, one step size per coordinate) under L1 and L2
penalties on a bounded sample, SAMPLE_PER_LANG documents of each language in expectation; a fifth of it is held back
and sets the softmax temperature.

A prediction depends on the model and the text alone, not on the texts next to it; so equal texts and repeated rows get
equal results in any partitioning. Null texts and texts without a letter get `und` and score 0, and so does every text if
there is nothing to learn from. Of languages of equal probability the first by name is taken. Whole texts are read however
long; a text longer than a block is a block of its own. A null doc_id is no hindrance. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoraspark.llm import textvec
from agoraspark.llm.common import class_share, crc_fold, stored

BITS = 15
ORDERS = (1, 2, 3)
SAMPLE_PER_LANG = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
NO_LANGUAGE = "und"


@lru_cache(1 << 16)
def _high_letter(code: int) -> int:
    """A letter beyond the basic plane in lower case, or a space for what is no letter."""
    c = chr(code)
    return ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else code if c.isalpha() else textvec.SEPARATOR


def letters(codes: np.ndarray) -> np.ndarray:
    """Code points with letters in lower case and a space for all others."""
    out = textvec.mapped(codes, textvec.letter_map())
    high = np.flatnonzero(out >= 1 << 16)
    if len(high):
        values, back = np.unique(out[high], return_inverse=True)
        out[high] = np.array([_high_letter(int(v)) for v in values], out.dtype)[back]
    return out


def gram_counts(block: textvec.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and how often each occurs; both empty for a text without letters."""
    codes = letters(block.codes)
    letter = codes != textvec.SEPARATOR
    after = np.append(letter[1:], False)
    found = []
    for order in ORDERS:
        use = letter if order == 1 else letter | after if order == 2 else after  # no windows around a lone space
        h = textvec.gram_hashes(codes, order, BITS)
        h[~use] = -1
        found.append(h)
    for i in range(block.n):
        a, b = block.window_range(i, 1)
        if not letter[a:b].any():
            yield np.zeros(0, np.int32), np.zeros(0)
            continue
        own = np.concatenate([h[slice(*block.window_range(i, order))] for order, h in zip(ORDERS, found, strict=True)])
        own = own[own >= 0]
        if len(own) < 4000:
            at, n = np.unique(own, return_counts=True)
        else:
            n = np.bincount(own, minlength=1 << BITS)
            at = np.flatnonzero(n)
            n = n[at]
        yield at.astype(np.int32), n.astype(float)


def tf_idf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic term frequency times inverse document frequency, at unit length."""
    x = (1 + np.log(n)) * idf[at]
    size = np.sqrt(x @ x)
    return x / size if size else x


FITTED_SCHEMA = "bucket int, n long, doc_id long, lang string, at binary, counts binary"


def _frequencies_and_sample(docs: DataFrame) -> DataFrame:
    """One pass over docs (doc_id, lang, text, chosen): how many texts of a task hold each bucket, and the grams of chosen rows.

    Rows with a bucket are counts (the bucket after the last counts texts with letters); those without are chosen texts,
    each kind of which a task gives once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, given = np.zeros((1 << BITS) + 1, np.int64), set()
        schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            ids, langs, chosen = (batch.column(k).to_pylist() for k in (0, 1, 3))
            rows = []
            for block in textvec.blocks(batch.column(2).to_pylist()):
                for i, (at, n) in enumerate(gram_counts(block), block.first):
                    counts[at] += 1
                    counts[-1] += len(at) > 0
                    if not chosen[i] or not len(at):
                        continue
                    row = (ids[i], langs[i], at.tobytes(), n.astype(np.float32).tobytes())
                    if row not in given:
                        given.add(row)
                        rows.append((None, None, *row))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        used = np.flatnonzero(counts)
        none = [pa.nulls(len(used), f.type) for f in list(schema)[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), *none], schema=schema)

    return docs.select("doc_id", "lang", "text", "chosen").mapInArrow(run, FITTED_SCHEMA)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket by class) and biases; coordinates whose gradients sum up to less than L1 stay zero."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    bias, seen = np.zeros(classes), np.full(classes, 1e-8)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax((bias + x @ w)[None, :])[0]
            p[target[i]] -= 1
            g = x[:, None] * p
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
            n[at] = grown
            seen += p * p
            bias -= 0.1 * p / np.sqrt(seen)
    return weights(z, n), bias


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm; 1 without rows."""
    if not len(target):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(target)), target]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> dict | None:
    """The model learned from text and lang of docs; None if no row has a language and letters."""
    known = docs.filter("lang is not null and text is not null").select(docs["doc_id"].cast("long").alias("doc_id"), "lang", "text")
    # by id and text, so that rows of one id or of none are drawn apart; repeated rows count once
    marked = known.withColumn("chosen", class_share(known, "lang", ["doc_id", "text"], per_lang))
    passed = stored(_frequencies_and_sample(marked), "langid-fit")
    df = np.zeros((1 << BITS) + 1, np.int64)
    for bucket, n in passed.filter("bucket is not null").groupBy("bucket").agg(F.sum("n")).collect():
        df[bucket] = n
    n_docs, df = int(df[-1]), df[:-1]
    if not n_docs:
        return None
    idf = np.log((1 + n_docs) / (1 + df)) + 0.1
    chosen = passed.filter("bucket is null").select("doc_id", "lang", "at", F.col("counts").alias("n")).distinct()
    sampled = sorted(chosen.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["at"]))
    langs = sorted({r["lang"] for r in sampled})
    rows, target = [], np.array([langs.index(r["lang"]) for r in sampled], int)
    for r in sampled:
        at = np.frombuffer(r["at"], np.int32)
        rows.append((at, tf_idf(at, np.frombuffer(r["n"], np.float32).astype(float), idf)))
    held = np.arange(len(rows)) % 5 == 4
    w, bias = train_ftrl([x for x, h in zip(rows, held, strict=True) if not h], target[~held], len(langs))
    logits = np.array([bias + x @ w[at] for (at, x), h in zip(rows, held, strict=True) if h]).reshape(-1, len(langs))
    return {"langs": langs, "idf": idf, "w": w, "bias": bias, "temperature": fit_temperature(logits, target[held])}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for block in textvec.blocks(batch.column(1).to_pylist()):
                for at, n in gram_counts(block):
                    if m is None or not len(at):
                        langs.append(NO_LANGUAGE)
                        scores.append(0.0)
                        continue
                    p = softmax(((m["bias"] + tf_idf(at, n, m["idf"]) @ m["w"][at]) / m["temperature"])[None, :])[0]
                    best = int(p.argmax())
                    langs.append(m["langs"][best])
                    scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column | str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 by 3."""
    return crc_fold(doc_id, 3) == 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from the rows that aren't held out."""
    model = fit(docs.filter(~held_out("doc_id")))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
