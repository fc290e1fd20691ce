"""Ranked lexical search over document-sharded postings with integer impacts, term at a time.

build_index() cuts the documents into shards of about SHARD_TOKENS terms, whatever partition they are in; each shard is one
row that holds its postings in compressed sparse rows: terms, how many postings each has, and for each posting the document's
place in the shard (two bytes) and its impact (four bytes). Impacts hold what a document contributes (term frequency against
the document's length); a term's weight, which needs the whole corpus, is multiplied in when a query asks for the term. The
shards lie in the shared folder, beside a vocabulary of terms and the documents that hold them, and can be asked many times.

search() takes queries in blocks of bounded text. Every task goes through its shards one at a time: for each query it adds the
postings of its terms, term after term, into a dense accumulator over the shard's documents, takes what is at or above the
k-th score (argpartition, then all ties of that score, the least ids of these) and merges it with what the shards before gave.
A task hands on k rows a query at most, and a window that Spark limits before its shuffle takes the best of those.

All arithmetic after a term's weight is in 64-bit integers (Python's own for lengths), so scores are equal however the
documents are dealt out. Bounds: a shard has SHARD_TOKENS terms and those of its last document; a block has BLOCK_BYTES of text in
expectation. No list of postings, no shard and no query set is gathered anywhere beyond these.

A null or empty text holds no term: such a document is in no result, such a query has no rows. Texts are split whole however
long. A null doc_id is returned as null and comes after all ids of its score. Rows of documents that repeat are ranked one after
the other. Queries that repeat in both columns count once; those that share an id but not the text are ranked apart. Empty
tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agoraspark.llm.common import stored

SHARD_TOKENS = 1 << 21
SHARD_DOCS = 1 << 16  # places in a shard are two bytes
SLICE = 1 << 20
BLOCK_BYTES = 4 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SHARD_SCHEMA = "doc_ids array<long>, terms array<string>, counts array<int>, docs binary, impacts binary"
HIT_SCHEMA = "block int, query int, item_id long, doc_id long, score long"


@dataclass(frozen=True)
class Index:
    """shards: one row a shard; vocabulary: term, df; n_docs: documents that hold a term; n_terms: all their terms."""

    shards: DataFrame
    vocabulary: DataFrame
    n_docs: int
    n_terms: int


class _Vocabulary(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, as UTF-8, in lists of about SLICE bytes.

    All bytes of characters beyond ASCII belong to terms, so that terms can be told apart by single bytes.
    """
    data, start = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES), 0
    while start < len(data):
        end = data.find(b" ", start + SLICE)
        end = len(data) if end < 0 else end
        if found := data[start:end].split():
            yield found
        start = end


class _Shard:
    """The postings of one shard while its documents come in."""

    def __init__(self, n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.vocabulary, self.size = _Vocabulary(), 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        n = 0
        for found in term_lists(text):
            self.tokens.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int32, len(found)))
            n += len(found)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.size += n

    def full(self) -> bool:
        return self.size >= SHARD_TOKENS or len(self.ids) >= SHARD_DOCS

    def row(self) -> pa.RecordBatch:
        n = len(self.ids)
        key = np.concatenate(self.tokens).astype(np.int64) * n + np.repeat(np.arange(n), self.lengths)
        key, tf = np.unique(key, return_counts=True)
        term, doc = np.divmod(key, n)
        m = np.array([100 - 25 + (25 * x * self.n_docs) // self.n_terms for x in self.lengths], np.int64)
        impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        columns = [
            pa.array([self.ids], pa.list_(pa.int64())),
            pa.array([[x.decode("utf-8", "replace") for x in self.vocabulary]], pa.list_(pa.string())),
            pa.array([np.bincount(term, minlength=len(self.vocabulary)).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([doc.astype("<u2").tobytes()], pa.binary()),
            pa.array([impacts.astype("<i4").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_ids", "terms", "counts", "docs", "impacts"])


def build_index(docs: DataFrame) -> Index:
    """The index of docs (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [sum(map(len, term_lists(text.as_py()))) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (sum(n > 0 for n in lengths), sum(lengths))], ["n_docs", "n_terms"])

    counted = docs.select(docs["text"]).mapInArrow(count, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = (n or 0 for n in counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(n_docs, n_terms)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(doc_id.as_py(), text.as_py())
                if shard.full():
                    yield shard.row()
                    shard = _Shard(n_docs, n_terms)
        if shard.ids:
            yield shard.row()

    shards = stored(docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SHARD_SCHEMA), "postings")
    held = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("t.terms", "t.counts")
    vocabulary = stored(held.groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df")), "vocabulary")
    return Index(shards, vocabulary, n_docs, n_terms)


def weight(df: int, n_docs: int) -> int:
    """What a term that df documents hold is worth."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by ascending id and those without an id last."""
    at = np.arange(len(scores))
    if len(scores) > k:
        kth = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        at = np.flatnonzero(scores >= kth)  # with all that tie at the k-th place
    return at[np.lexsort((ids[at], missing[at], -scores[at]))[:k]]


class _Searcher:
    """Queries of a block, and the best documents of the shards so far. queries: for each its terms' numbers and weights."""

    def __init__(self, terms: list[str], queries: list[list[tuple[int, int]]], k: int) -> None:
        self.terms, self.queries, self.k = pa.array(terms, pa.string()), queries, k
        none = np.zeros(0, np.int64)
        self.found = [(none, none, none.astype(bool)) for _ in queries]

    def take(self, doc_ids: pa.Array, terms: pa.Array, counts: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        """Score one shard."""
        starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = pc.fill_null(pc.index_in(self.terms, value_set=terms), -1).to_numpy(zero_copy_only=False)
        missing = doc_ids.is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
        score = np.zeros(len(ids), np.int64)
        for q, asked in enumerate(self.queries):
            score[:] = 0
            for term, weight_ in asked:
                if (t := at[term]) >= 0:
                    here = slice(starts[t], starts[t + 1])
                    score[docs[here]] += weight_ * impacts[here].astype(np.int64)  # a document stands once in a list
            old, old_ids, old_missing = self.found[q]
            hit = np.flatnonzero(score >= (max(1, old[-1]) if len(old) == self.k else 1))
            if len(hit):
                new = np.concatenate([old, score[hit]]), np.concatenate([old_ids, ids[hit]]), np.concatenate([old_missing, missing[hit]])
                keep = best(*new, self.k)
                self.found[q] = tuple(x[keep] for x in new)

    def rows(self, block: int, item_ids: list[int | None]) -> Iterator[pa.RecordBatch]:
        names = ["block", "query", "item_id", "doc_id", "score"]
        for q, (score, ids, missing) in enumerate(self.found):
            if n := len(score):
                columns = [pa.array([x] * n, kind) for x, kind in ((block, pa.int32()), (q, pa.int32()), (item_ids[q], pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.int64(), mask=missing), pa.array(score, pa.int64())], names)


def _block_hits(index: Index, rows: list, block: int, k: int) -> DataFrame:
    """The best k documents of each task's shards for the queries in rows (item_id, text)."""
    spark = index.shards.sparkSession
    counted = [Counter(t.decode("utf-8", "replace") for found in term_lists(text) for t in found) for _, text in rows]
    asked = sorted(set().union(*counted))
    terms = F.broadcast(spark.createDataFrame([(t,) for t in asked], "term string"))  # those of a block, which is bounded
    known = {r["term"]: weight(r["df"], index.n_docs) for r in index.vocabulary.join(terms, "term", "left_semi").collect()}
    names = sorted(known)
    number = {t: i for i, t in enumerate(names)}
    queries = [[(number[t], n * known[t]) for t, n in c.items() if known.get(t)] for c in counted]
    item_ids = [r[0] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _Searcher(names, queries, k)
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, held, counts = (batch.column(c)[i].values for c in range(3))
                docs, impacts = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((3, "<u2"), (4, "<i4")))
                searcher.take(doc_ids, held, counts.to_numpy(), docs, impacts)
        yield from searcher.rows(block, item_ids)

    return index.shards.mapInArrow(run, HIT_SCHEMA)


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each of items (item_id, text)."""
    asked = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("text")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = -(-size // BLOCK_BYTES) or 1
    hits = None
    for block in range(n_blocks):
        rows = sorted(asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        found = _block_hits(index, rows, block, k)
        hits = hits.unionAll(found) if hits else found
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
