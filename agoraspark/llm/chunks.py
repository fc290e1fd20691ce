"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; its value at each word's end depends on the last 16 bytes alone. A
word end whose value is the greatest of its neighbourhood (three words either way) ends a chunk, so chunks hold four
words or more, seven on average, and an insertion moves the boundaries around it only. A stretch of words without such
an end is cut every 64 words. Words of over LONG_BYTES bytes (scripts without blanks, encoded data) are cut into parts where
the gear hash says so, at characters, of eight bytes on average, and each part counts as a word for every WORD_BYTES bytes;
where the hash says nothing for LONG_BYTES bytes, a part ends there. Chunks are known by a 64-bit digest of their bytes
without outer white space.

A chunk is a repeat if an earlier document, or an earlier place of its own, holds it. Documents are in the order of doc_id
(none first) and, for rows that share one, of a hash of their texts. Repeats that follow each other make a run; a run of
min_words words or more is cut out, so that the first holder alone keeps a shared passage, while single common phrases stay.
Every chunk that goes has a copy that stays. Digests that many documents hold are few and are looked up by broadcast; the
others are joined by digest.

Null and empty texts have no chunks. Rows that repeat both doc_id and text are one document: neither makes the other's
chunks repeats, and both are cut alike; rows that share a doc_id with other texts are documents of their own. Texts are cut
whole however long. Ties between hashes go to the later word end. An empty table gives an empty result. Other columns stay
as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraspark.llm.common import NO_ID, drop_tools, row_key, stored, unclashing

REACH = 3
LONGEST_WORDS = 64
MIN_WORDS = 25
LONG_BYTES = 64
PART_BYTES = 8  # bytes between two ends within a long word, on average
WORD_BYTES = 6
HOT_DOCUMENTS = 10_000  # holders from which a digest is broadcast, or more, so that at most HOT_DIGESTS are
HOT_DIGESTS = 200_000  # of 24 bytes each
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 7) & 0xFFFF for i in range(256)], np.uint16)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the rolling hash h = 2 h + gear[byte] modulo 2**16, that is of the last 16 bytes."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[step:] = h[:-step]
        h = h + (older << np.uint16(step))
    return h


def word_ends(data: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last byte of each word or part of a long word, and how many words it counts as."""
    space = _SPACE[data]
    last = np.flatnonzero(~space & np.append(space[1:], True))
    if not len(last):
        return last, last
    first = np.flatnonzero(~space & np.insert(space[:-1], 0, True))
    long_ = last - first >= LONG_BYTES
    if not long_.any():
        return last, np.ones(len(last), np.int64)
    character = np.append(data[1:] & 0xC0 != 0x80, True)  # a character ends here
    cuts, counts = [last[~long_]], [np.ones(int((~long_).sum()), np.int64)]
    for a, b in zip(first[long_].tolist(), last[long_].tolist(), strict=True):
        inside = a + np.flatnonzero(character[a:b])
        found = inside[h[inside] % PART_BYTES == 0]
        edge = np.concatenate([[a - 1], found, [b]])
        wide = np.flatnonzero(np.diff(edge) > LONG_BYTES)
        if len(wide):  # every LONG_BYTES bytes, and on to the end of that character
            more = np.concatenate([np.arange(edge[k] + LONG_BYTES, edge[k + 1], LONG_BYTES) for k in wide.tolist()])
            more = inside[np.minimum(np.searchsorted(inside, more), len(inside) - 1)]
            found = np.unique(np.concatenate([found, more]))
        edge = np.unique(np.append(found, b))
        cuts.append(edge)
        counts.append(np.diff((edge - a + 1) // WORD_BYTES, prepend=0))
    where, weight = np.concatenate(cuts), np.concatenate(counts)
    order = np.argsort(where, kind="stable")
    return where[order], weight[order]


def chunk_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of a text (bytes) end, white space after a word included, and how many words each has."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none
    hashed = gear(data)
    last, weight = word_ends(data, hashed)
    if not len(last):
        return none, none
    h = hashed[last].astype(np.int32)
    top = np.ones(len(h), bool)
    for k in range(1, REACH + 1):
        top[k:] &= h[k:] > h[:-k]
        top[:-k] &= h[:-k] >= h[k:]
    top[-1] = True
    cut = np.flatnonzero(top)
    sizes = np.diff(cut, prepend=-1)
    if sizes.max() > LONGEST_WORDS:
        more = [cut]
        for c, size in zip(cut[sizes > LONGEST_WORDS].tolist(), sizes[sizes > LONGEST_WORDS].tolist(), strict=True):
            more.append(np.arange(c - size + LONGEST_WORDS, c, LONGEST_WORDS))
        cut = np.unique(np.concatenate(more))
    # a chunk goes on to the byte before the next that is no white space
    solid = np.flatnonzero(~_SPACE[data])
    ends = np.append(solid[np.searchsorted(solid, last[cut[:-1]], side="right")], len(data))
    total = np.append(0, np.cumsum(weight))
    return ends, np.diff(total[cut + 1], prepend=0)


CHUNK_SCHEMA = "doc_id long, row long, digest long, start int, stop int, n_words int, own boolean"


def chunks(docs: DataFrame) -> DataFrame:
    """Every chunk of every text: doc_id and row (row_key), digest, place in bytes, words, and whether the text held it before (own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tools()
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                owners, digests, begins, stops, counts, own = [], [], [], [], [], []
                for i, value in enumerate(part.column(2)):
                    raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                    ends, words = chunk_ends(np.frombuffer(raw, np.uint8))
                    if not len(ends):
                        continue
                    cuts = ends.tolist()
                    found = np.array([digest(raw[a:b].strip()) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], np.uint64).view(np.int64)
                    repeat = np.ones(len(found), bool)
                    repeat[np.unique(found, return_index=True)[1]] = False
                    owners.append(np.full(len(found), i))
                    digests.append(found)
                    begins.append(np.append(0, ends[:-1]))
                    stops.append(ends)
                    counts.append(words)
                    own.append(repeat)
                if owners:
                    at = pa.array(np.concatenate(owners))
                    numbers = [pa.array(np.concatenate(v).astype(np.int32)) for v in (begins, stops, counts)]
                    columns = [part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(digests)), *numbers, pa.array(np.concatenate(own))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "digest", "start", "stop", "n_words", "own"])

    doc, row = row_key(docs)
    return docs.select(doc.alias("doc_id"), row.alias("row"), docs["text"].alias("text")).mapInArrow(run, CHUNK_SCHEMA)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows that hold runs of repeats: doc_id (null as it was), row (hash of the text), spans (array of start, stop in UTF-8 bytes), n_spans, words_cut, bytes_cut."""
    found = stored(chunks(docs), "chunks")
    holder = F.struct("doc_id", "row")
    holders = found.filter("not own").groupBy("digest").agg(F.min(holder).alias("first"), F.max(holder).alias("last"), F.count(F.lit(1)).alias("n"))
    shared = stored(holders.filter("first < last").select("digest", F.col("first.doc_id").alias("first_doc"), F.col("first.row").alias("first_row"), "n"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    many = max(HOT_DOCUMENTS, total // HOT_DIGESTS)  # at most total / many digests have so many holders
    place = ["doc_id", "row", "start", "stop", "n_words"]
    later = (F.col("doc_id") > F.col("first_doc")) | ((F.col("doc_id") == F.col("first_doc")) & (F.col("row") > F.col("first_row")))
    fresh = found.filter("not own")
    hot, rare = F.broadcast(shared.filter(F.col("n") >= many).drop("n")), shared.filter(F.col("n") < many).drop("n")
    repeats = [fresh.join(side, "digest").filter(later).select(*place) for side in (hot, rare)]
    # a chunk that the text itself held before is a repeat whatever other documents hold
    every = repeats[0].unionByName(repeats[1]).unionByName(found.filter("own").select(*place))
    listed = every.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "n_words"))).alias("places"))
    return listed.mapInArrow(lambda batches: _runs(batches, min_words), RUN_SCHEMA).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


RUN_SCHEMA = "doc_id long, row long, spans array<struct<start:int,stop:int>>, n_spans long, words_cut long, bytes_cut long"


def _runs(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Join the places of a document that touch, and keep those of min_words words or more."""
    for batch in batches:
        rows = []
        for doc_id, row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            start, stop, words = (value.values.field(k).to_numpy() for k in range(3))
            head = np.flatnonzero(np.append(True, start[1:] != stop[:-1]))
            tail = np.append(head[1:], len(start)) - 1
            total = np.add.reduceat(words, head).astype(np.int64)
            use = total >= min_words
            if use.any():
                spans = [{"start": a, "stop": b} for a, b in zip(start[head[use]].tolist(), stop[tail[use]].tolist(), strict=True)]
                rows.append((doc_id, row, spans, len(spans), int(total[use].sum()), sum(x["stop"] - x["start"] for x in spans)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "row", "spans", "n_spans", "words_cut", "bytes_cut"])


def remove_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the runs of repeats; n_chars is set anew where it is a column. Documents of which nothing is left go."""
    run_doc, run_row, spans = unclashing(docs, "run_doc", "run_row", "spans")
    runs = repeated_runs(docs, min_words).select(F.col("doc_id").alias(run_doc), F.col("row").alias(run_row), F.col("spans").alias(spans))
    _, row = row_key(docs)
    marked = docs.join(runs, docs["doc_id"].cast("long").eqNullSafe(runs[run_doc]) & (row == runs[run_row]), "left").drop(run_doc, run_row)
    raw = F.encode("text", "utf-8")
    # the kept pieces lie between a span's stop and the next one's start
    kept = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["stop"])),
        F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.octet_length("text"))),
        lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "utf-8"),
    )
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    out = marked.withColumn("text", text).filter(F.col(spans).isNull() | (F.trim("text") != "")).drop(spans)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
