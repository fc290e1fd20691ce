"""Text quality without labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Each labeller votes good, bad or nothing on a whole text. The votes of all documents are counted by pattern (there are
at most 3**9 patterns, however many documents), and a two-class latent model is fitted to the counts: the class prior
and, for each labeller, how often it votes what on either class. Posteriors of the patterns label a bounded sample
of documents (SAMPLE_ROWS), on which a linear scorer over hashed character shapes is trained; it scores every document.

A score depends on the model and the text alone, not on the texts next to it; so equal texts and repeated rows get equal
scores in any partitioning. Null and empty texts, and texts without a letter or digit, score 0 and are not kept. Texts are
read whole however long. Rows of a null doc_id are scored, sampled and kept like others. Patterns on which the classes tie
have a posterior of one half; a score of exactly one half is kept. Without rows nothing is learned and nothing is returned.
Other columns are ignored by the scores and stay as they are in keep_good, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoraspark.llm import textvec
from agoraspark.llm.common import drop_tools, stored, unit_hash

BITS = 14
SAMPLE_ROWS = 6000  # documents that the scorer is trained on, in expectation
ROUNDS = 40
LABELLERS = ("symbols", "capitals", "variety", "doubling", "loose_marks", "word_length", "short_words", "endings", "heavy_punctuation")
GOOD, BAD, NONE = 1, 0, 2


def measures(block: textvec.Block) -> dict[str, np.ndarray]:
    """Per text: counts from which the labellers decide."""
    codes, starts = block.codes, block.starts[:-1]
    low = textvec.mapped(codes, textvec.word_map())
    word_char = low != textvec.SEPARATOR
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    total = lambda flags: np.add.reduceat(flags.astype(np.float64), starts)
    owner, _, hashed = textvec.words(block, textvec.word_map())
    n_words = np.bincount(owner, minlength=block.n).astype(np.float64)
    order = np.lexsort((hashed, owner))
    so, sh = owner[order], hashed[order]
    fresh = np.append(True, (so[1:] != so[:-1]) | (sh[1:] != sh[:-1])) if len(so) else np.zeros(0, bool)
    distinct = np.bincount(so[fresh], minlength=block.n).astype(np.float64)
    twice = np.bincount(owner[1:][(hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])], minlength=block.n).astype(np.float64)
    upper = (codes != low) & word_char
    mark = ~word_char & ~blank
    heavy = mark[1:] & mark[:-1]
    run_start = np.append(heavy[0] if len(heavy) else False, heavy[1:] & ~heavy[:-1]) if len(heavy) else heavy
    alone = mark[1:-1] & blank[:-2] & blank[2:]
    begin_word = word_char & ~np.append(False, word_char[:-1])
    edge = np.flatnonzero(np.diff(word_char.astype(np.int8), prepend=0, append=0))
    length = edge[1::2] - edge[0::2]
    short = np.bincount(owner[length <= 3], minlength=block.n).astype(np.float64)
    closing = np.isin(codes, [ord("."), ord("!"), ord("?"), 0x3002])
    return {
        "letters": total(word_char),
        "upper": total(upper & ~begin_word),
        "inner": total(word_char & ~begin_word),
        "visible": total(~blank),
        "marks": total(mark),
        "words": n_words,
        "distinct": distinct,
        "twice": twice,
        "alone": total(np.concatenate([[False], alone, [False]]) if len(codes) > 2 else np.zeros(len(codes), bool)),
        "heavy": total(np.append(run_start, False)),
        "short": short,
        "closing": total(closing),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text, one column per labeller: GOOD, BAD or NONE."""
    words, few = np.maximum(m["words"], 1), m["words"] < 20

    def by(ratio: np.ndarray, good: float, bad: float, quiet: np.ndarray | None = None) -> np.ndarray:
        """Good on one side of a threshold, bad beyond the other, nothing between."""
        out = np.full(len(ratio), NONE, np.int8)
        out[ratio <= good if good < bad else ratio >= good] = GOOD
        out[ratio >= bad if good < bad else ratio <= bad] = BAD
        out[m["words"] == 0] = BAD
        if quiet is not None:
            out[quiet & (m["words"] > 0)] = NONE
        return out

    mean = m["letters"] / words
    long_enough = m["words"] >= 20
    columns = [
        by(m["marks"] / np.maximum(m["visible"], 1), 0.08, 0.12),
        by(m["upper"] / np.maximum(m["inner"], 1), 0.02, 0.15),
        by(m["distinct"] / words / np.minimum(1, 12 / np.sqrt(words)), 0.45, 0.3, few),
        by(m["twice"] / words, 0.02, 0.06, few),
        by(m["alone"] / words, 0.01, 0.05),
        by(np.abs(np.log(np.maximum(mean, 0.1) / 5.2)), 0.5, 0.8, few),
        by(m["short"] / words, 0.2, 0.08, few),
        by(m["closing"] / words, 0.02, 0.008, ~long_enough),
        by(m["heavy"] / words, 0.01, 0.05),
    ]
    return np.column_stack(columns)


@lru_cache(1)
def shape_map() -> np.ndarray:
    """Code points of the basic plane by shape: letters a or A, digits 0, white space as a space, others as they are."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalpha():
            out[i] = ord("A") if c.isupper() else ord("a")
        elif c.isdigit():
            out[i] = ord("0")
        elif c.isspace():
            out[i] = 32
    return out


def features(block: textvec.Block, m: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each text: relative frequencies of shape n-grams (2 and 4), and measures in steps."""
    codes = textvec.mapped(block.codes, shape_map())
    grams = [(order, textvec.gram_hashes(codes, order, BITS)) for order in (2, 4)]
    words = np.maximum(m["words"], 1)
    shares = (("marks", "visible"), ("upper", "inner"), ("twice", "words"), ("alone", "words"), ("heavy", "words"), ("short", "words"))
    steps = [np.minimum(20, (20 * m[a] / np.maximum(m[b], 1)).astype(int)) for a, b in shares] + [np.minimum(20, (20 * m["distinct"] / words / np.minimum(1, 12 / np.sqrt(words))).astype(int))]
    counts = np.zeros(1 << BITS)
    for i in range(block.n):
        own = np.concatenate([g[slice(*block.window_range(i, order))] for order, g in grams])
        counts[:] = 0
        np.add.at(counts, own, 1.0 / len(own)) if len(own) < 2000 else counts.__iadd__(np.bincount(own, minlength=1 << BITS) / len(own))
        for k, step in enumerate(steps):
            counts[(k * 0x9E3779B1 + int(step[i]) * 0x85EBCA77 + 12345) % (1 << BITS)] += 0.5
        at = np.flatnonzero(counts)
        yield at.astype(np.int32), np.sqrt(counts[at])


FITTED_SCHEMA = "votes string, n long, place long, at binary, x binary"


def _votes_and_sample(docs: DataFrame) -> DataFrame:
    """One pass over docs (place, text, chosen): how many texts of a task have each pattern of votes, and the chosen texts.

    Rows with n are counts; the others are features of chosen texts, of which a task gives each kind once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tools()
        schema = pa.schema([("votes", pa.string()), ("n", pa.int64()), ("place", pa.int64()), ("at", pa.binary()), ("x", pa.binary())])
        tally: dict[str, int] = {}
        given = set()
        for batch in batches:
            places, chosen = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for block in textvec.blocks(batch.column(1).to_pylist()):
                m = measures(block)
                found = patterns_of(m)
                for v in found:
                    tally[v] = tally.get(v, 0) + 1
                if not any(chosen[block.first : block.first + block.n]):
                    continue
                for i, (at, x) in enumerate(features(block, m)):
                    row = (found[i], None, places[block.first + i], at.tobytes(), x.astype(np.float32).tobytes())
                    if chosen[block.first + i] and row not in given:
                        given.add(row)
                        rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        none = [pa.nulls(len(tally), f.type) for f in list(schema)[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64()), *none], schema=schema)

    return docs.select("place", "text", "chosen").mapInArrow(run, FITTED_SCHEMA)


def patterns_of(m: dict[str, np.ndarray]) -> list[str]:
    """The votes of each text, one digit per labeller."""
    return ["".join(map(str, row)) for row in votes(m).tolist()]


def fit_labellers(patterns: list[tuple[str, int]]) -> tuple[dict[str, float], np.ndarray, float]:
    """EM over pattern counts. Returns the posterior of good per pattern, P(vote | class, it votes) by labeller, and the prior of good.

    Starts from majority votes, so that good is the class most good votes fall in. Agreeing labellers aren't independent;
    posteriors are kept within 0.01 and 0.99.
    """
    if not patterns:
        return {}, np.full((2, len(LABELLERS), 3), 1 / 3), 0.5
    v = np.array([[int(c) for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    post = np.clip((good + 1) / (good + bad + 2) + np.where(bad >= 2, -0.4, 0), 0.02, 0.98)
    rates, prior = np.full((2, v.shape[1], 3), 1 / 3), 0.5
    for _ in range(ROUNDS):
        prior = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
        for c, weight in ((GOOD, n * post), (BAD, n * (1 - post))):
            for j in range(v.shape[1]):
                tally = np.bincount(v[:, j], weights=weight, minlength=3)[:2] + 1.0
                rates[c, j, :2], rates[c, j, NONE] = tally / tally.sum(), 1.0
        logs = [np.log(p) + np.log(rates[c])[np.arange(v.shape[1]), v].sum(axis=1) for c, p in ((GOOD, prior), (BAD, 1 - prior))]
        post = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -30, 30)))
    return {p: float(np.clip(x, 0.01, 0.99)) for (p, _), x in zip(patterns, post, strict=True)}, rates, prior


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 12, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by AdaGrad, a row at a time in a fixed order."""
    w, bias, seen, seen_bias = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), 1e-8
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[i]
            slip = 1 / (1 + np.exp(-np.clip(bias + w[at] @ x, -30, 30))) - target[i]
            g = slip * x + decay * w[at]
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
            seen_bias += slip * slip
            bias -= rate * slip / np.sqrt(seen_bias)
    return w, bias


def in_sample(docs: DataFrame, share: float) -> Column:
    """Whether a row is drawn: by a hash of id and text, so that rows of one id or of none are drawn apart.

    Repeated rows count once in the sample, so a row that fills much of the table is one row of it at most.
    """
    return unit_hash(docs["doc_id"].cast("long"), docs["text"]) < share


def fit(docs: DataFrame) -> tuple[np.ndarray, float, dict[str, float]]:
    """Weights and bias of the scorer, and the posterior of good by pattern of votes. docs is counted, then read once."""
    total = docs.count()
    marked = docs.select(F.xxhash64(docs["doc_id"].cast("long")).alias("place"), docs["text"].alias("text"), in_sample(docs, min(1.0, SAMPLE_ROWS / max(1, total))).alias("chosen"))
    passed = stored(_votes_and_sample(marked), "quality-fit")
    patterns = [(r[0], r[1]) for r in passed.filter("n is not null").groupBy("votes").agg(F.sum("n")).collect()]  # at most 3**9
    posterior, _, _ = fit_labellers(sorted(patterns))
    rows, targets = [], []
    chosen = passed.filter("n is null").select("votes", "place", "at", "x").distinct()
    for r in sorted(chosen.collect(), key=lambda r: (r["place"], r["at"], r["x"])):
        rows.append((np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(float)))
        targets.append(posterior.get(r["votes"], 0.5))
    return *fit_scorer(rows, np.array(targets)), posterior


def _score(texts: list[str | None], model: tuple[np.ndarray, float, dict[str, float]]) -> tuple[list[float], list[float]]:
    """Posteriors and scores of texts."""
    weights, offset, post = model
    scores, posts = [], []
    for block in textvec.blocks(texts):
        m = measures(block)
        posts += [post.get(v, 0.5) for v in patterns_of(m)]
        for i, (at, x) in enumerate(features(block, m)):
            z = offset + weights[at] @ x
            scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) if m["words"][i] else 0.0)
    return posts, scores


def quality_scores(docs: DataFrame) -> DataFrame:
    """doc_id, posterior (of good, by the labellers), score (of the trained scorer), keep (score of 0.5 or more), for every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))  # 2**14 weights, at most 3**9 patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tools()
        for batch in batches:
            posts, scores = _score(batch.column(1).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(posts, pa.float64()), pa.array(scores, pa.float64())], ["doc_id", "posterior", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(run, "doc_id long, posterior double, score double").withColumn("keep", F.col("score") >= 0.5)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the scorer keeps, all columns as they are.

    Rows pass the scorer whole and are dropped there, so nothing is joined or shuffled, and every row is decided by its own
    text, whatever its id.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tools()
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                _, scores = _score(part.column(place).to_pylist(), model.value)
                yield part.filter(pa.array([x >= 0.5 for x in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
