"""Token ids of documents in binary shards, and a minimal perfect hash index that finds a document's ids in constant time.

write_store() encodes documents and writes, in ascending order of doc_id,
  ids-NNNNNN.bin    the raw ids of a shard's documents, one after the other, two or four bytes each, little-endian;
  ids-NNNNNN.tab    the shard's doc_ids and where each document begins;
  keys-NNNNNN.mph   the index of a bucket of keys: for every doc_id the shard and place of its first row.
Files are written under temporary names and renamed when complete; the manifests, which Spark commits, list those that count,
so what a lost attempt leaves behind isn't read. Shards are ranges of ids from exact sums of text sizes. Texts are encoded before
they are shuffled, once; what is shuffled is ids.

A bucket's index is a cascade of bit arrays: a key that is alone at its place in the first array has its bit there, the others
try the next one with another hash. The number of bits before a key's bit is its slot, so n keys have the slots 0 to n-1.
A slot stores a fingerprint of 32 bits, so an absent key is taken for a present one once in 2**32 askings, and a present key is
always found. Keys are dealt to buckets by a hash, so buckets are even whatever the ids are.

read_store() looks keys up in their buckets and reads their ids at the places found. encode() is that of the tokenizers library
without special tokens (their strings in a text are ordinary text); what is between blanks is encoded once a worker.

A null text counts as empty: such a document has the end id alone. Rows without doc_id come first and are kept under NO_ID (the
least long, which isn't an id here). Rows that share a doc_id lie side by side, by a hash of their texts, and are all
returned for it; ids that hold more than a shard are dealt over several. Texts are encoded whole however long. An empty table gives no
files. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agoraspark.llm.common import NO_ID, own_folder, stored
from agoraspark.llm.ranges import Deal, id_ranges

LEAST_SHARD, MOST_SHARD = 1 << 20, 256 << 20  # of text, with ROW_BYTES for each document
ROW_BYTES = 64
BUCKET_KEYS = 1 << 16
GAMMA = 2  # bits a key in each array of the cascade
CACHED_UNITS = 1 << 18
SLICE_WORDS = 1 << 19
SEPARATOR, JOINED = "0", 2000
STOPPED = r"^(?P<word>[a-z\x{E0}-\x{F6}\x{F8}-\x{17F}]+)(?P<stops>[.,]+)$"
READ_AHEAD = 1 << 20
PLACE_SCHEMA = "shard int, doc_id long, start long, n long, sha256 string"
BUCKET_SCHEMA = "bucket int, keys long, bytes long, sha256 string"
FOUND_SCHEMA = "shard int, doc_id long, start long, n long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
_WORKER: dict[str, Encoder] = {}


@dataclass(frozen=True)
class Store:
    """folder: of all files. shards: shard, n_docs, n_tokens, first_id, last_id, sha256. buckets: bucket, keys, bytes, sha256."""

    folder: str
    shards: DataFrame
    buckets: DataFrame
    width: int


# encoding


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of flat that begin at starts, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(total, dtype=kind)]


class Encoder:
    """Encodes texts by the words between ASCII blanks, which no token spans; the ids of frequent ones are kept for the next time.

    Capitals of ASCII are made small first, as the tokenizer does it anyway. A word of letters with stops after it is two units,
    since the tokenizer's pattern cuts there; only letters that every version of Unicode knows count for that. Each distinct
    unit is encoded once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ids = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = ids[0] if len(ids) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, and how many each has. Units without the separator go many in a text, and are told apart by its id."""
        joined = np.array([self.separator is not None and SEPARATOR not in u for u in units], bool)
        many, lengths = [u for u, j in zip(units, joined, strict=True) if j], np.zeros(len(units), np.int64)
        groups = self._ids([f" {SEPARATOR} ".join(many[i : i + JOINED]) + f" {SEPARATOR}" for i in range(0, len(many), JOINED)])
        alone = self._ids([u for u, j in zip(units, joined, strict=True) if not j])
        ids = np.concatenate([np.zeros(0, np.uint32), *groups])
        cut = ids == self.separator if many else np.zeros(0, bool)
        lengths[joined] = np.diff(np.flatnonzero(cut), prepend=-1) - 1
        lengths[~joined] = [len(x) for x in alone]
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        starts = np.empty(len(units), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return gather(np.concatenate([ids[~cut], *alone]), starts, lengths), lengths

    def _units(self, units: list[str], often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat, starts and lengths of the ids of distinct units; those that come often are kept."""
        if len(self.known) > CACHED_UNITS:
            self.forget()
        number = np.fromiter((self.known.get(u, -1) for u in units), np.int64, len(units))
        fresh, old = np.flatnonzero(number < 0), np.flatnonzero(number >= 0)
        flat, new = self._encode_units([units[i] for i in fresh.tolist()])
        starts, lengths, base = np.empty(len(units), np.int64), np.empty(len(units), np.int64), len(self.flat)
        starts[old], lengths[old] = self.starts[number[old]], self.lengths[number[old]]
        starts[fresh], lengths[fresh] = base + np.cumsum(new) - new, new
        whole, keep = np.concatenate([self.flat, flat]), fresh[often[fresh]]
        self.known.update(zip((units[i] for i in keep.tolist()), range(len(self.starts), len(self.starts) + len(keep)), strict=True))
        self.flat = np.concatenate([self.flat, gather(whole, starts[keep], lengths[keep])])
        self.starts = np.concatenate([self.starts, base + np.cumsum(lengths[keep]) - lengths[keep]])
        self.lengths = np.concatenate([self.lengths, lengths[keep]])
        return whole, starts, lengths

    def _words(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat, starts and lengths of the ids of distinct words. counts: how often each comes."""
        parts = pc.extract_regex(words, STOPPED)
        two = parts.is_valid()
        stopped = two.to_numpy(zero_copy_only=False)
        units = pa.concat_arrays([pc.if_else(two, parts.field(0), words), parts.field(1).filter(two)]).dictionary_encode()
        unit = units.indices.to_numpy()
        n = np.bincount(unit, np.concatenate([counts, counts[stopped]]), len(units.dictionary))
        flat, starts, lengths = self._units(units.dictionary.to_pylist(), n > 1)
        size = 1 + stopped
        place = np.cumsum(size) - size
        pieces = np.empty(int(size.sum()), np.int64)
        pieces[place] = unit[: len(words)]
        pieces[place[stopped] + 1] = unit[len(words) :]
        total = np.add.reduceat(lengths[pieces], place) if len(place) else place
        return gather(flat, starts[pieces], lengths[pieces]), np.cumsum(total) - total, total

    def encode(self, texts: pa.Array, end_id: int, kind: str) -> pa.Array:
        """The ids of each text and end_id after them, as bytes of kind."""
        listed = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        split = pc.dictionary_encode(listed.flatten())
        number = split.indices.to_numpy()
        flat, starts, lengths = self._words(split.dictionary, np.bincount(number, minlength=len(split.dictionary)))
        flat = flat.astype(kind)
        bounds = listed.offsets.to_numpy().astype(np.int64) - listed.offsets[0].as_py()
        counts = np.zeros(len(texts) + 1, np.int64)
        sums = np.concatenate([[0], np.cumsum(lengths[number])])
        counts[1:] = sums[bounds[1:]] - sums[bounds[:-1]] + 1
        ends = np.cumsum(counts)
        out, inside = np.empty(ends[-1], kind), np.ones(ends[-1], bool)
        out[ends[1:] - 1], inside[ends[1:] - 1] = end_id, False
        slices = (number[i : i + SLICE_WORDS] for i in range(0, len(number), SLICE_WORDS))
        out[inside] = np.concatenate([np.zeros(0, kind), *(gather(flat, starts[n], lengths[n]) for n in slices)])
        offsets = ends * out.itemsize
        if offsets[-1] >= 1 << 31:
            raise ValueError("the ids of a batch are beyond 2 GB; set spark.sql.execution.arrow.maxBytesPerBatch lower")
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _encoder(path: str) -> Encoder:
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


# the index


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 bits that depend on keys and seed; distinct keys have distinct ones."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, -2) >> np.uint64(32)).astype("<u4")


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return ((mix(keys, level) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """A line that says what follows, and the arrays."""
    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in arrays.items()}).encode() + b"\n"
    return head + b"".join(v.tobytes() for v in arrays.values())


def unpack(data: bytes) -> dict[str, np.ndarray]:
    start, out = data.index(b"\n") + 1, {}
    for name, (kind, n) in json.loads(data[:start]).items():
        out[name] = np.frombuffer(data, kind, n, start)
        start += out[name].nbytes
    return out


def build_hash(keys: np.ndarray) -> dict[str, np.ndarray]:
    """levels, bits and ranks of a minimal perfect hash of distinct keys (int64)."""
    left, sizes, words = keys, [], []
    while len(left):
        size = -(-GAMMA * len(left) // 64) * 64
        place = _place(left, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone[place]]
    bits = np.concatenate(words) if words else np.zeros(0, "<u8")
    counts = np.bitwise_count(bits).astype(np.int64)
    return {"levels": np.array(sizes, "<i8"), "bits": bits, "ranks": (np.cumsum(counts) - counts).astype("<u4")}


def slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for some that are absent; the others of these have the slot of another key."""
    out, base, left = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
    for level, size in enumerate(index["levels"].tolist()):
        at = base + _place(keys[left], level, size)
        word, bit = index["bits"][at >> 6], (at & 63).astype(np.uint64)
        here = (word >> bit & np.uint64(1)).astype(bool)
        before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[left[here]] = (index["ranks"][at >> 6] + before)[here]
        left, base = left[~here], base + size
    return out


def build_bucket(keys: np.ndarray, shard: np.ndarray, start: np.ndarray, n: np.ndarray, rows: np.ndarray) -> bytes:
    """The file of a bucket: the hash, and what stands in each slot."""
    index = build_hash(keys)
    order = np.argsort(slots(index, keys))
    values = {"fingerprints": fingerprint(keys), "shard": shard.astype("<i4"), "start": start.astype("<i8"), "n": n.astype("<i8"), "rows": rows.astype("<i8")}
    return pack(index | {k: v[order] for k, v in values.items()})


def find(bucket: dict[str, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the bucket holds, and the slots of those."""
    slot = slots(bucket, keys)
    known = slot >= 0
    known[known] = bucket["fingerprints"][slot[known]] == fingerprint(keys[known])
    return known, slot[known]


# files


class _Files:
    """Files that get their names when they are complete."""

    def __init__(self, folder: str) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(folder)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def open(self, name: str) -> tuple[pa.NativeFile, str]:
        temporary = self.path(f".{name}.{uuid.uuid4().hex}")
        return self.store.open_output_stream(temporary, compression=None), temporary

    def put(self, name: str, data: bytes) -> None:
        out, temporary = self.open(name)
        out.write(data)
        out.close()
        self.store.move(temporary, self.path(name))

    def get(self, name: str) -> bytes:
        with self.store.open_input_stream(self.path(name), compression=None) as source:
            return source.read()

    def tidy(self) -> None:
        """Remove what attempts that failed have left."""
        for left in self.store.get_file_info(fs.FileSelector(self.folder)):
            if left.base_name.startswith((".ids-", ".keys-")):
                self.store.delete_file(left.path)


def _names(shard: int) -> tuple[str, str]:
    return f"ids-{shard:06d}.bin", f"ids-{shard:06d}.tab"


class _ShardWriter:
    """Writes one shard, as its documents come in."""

    def __init__(self, files: _Files, shard: int) -> None:
        self.files, self.shard, self.digest = files, shard, hashlib.sha256()
        self.out, self.temporary = files.open(_names(shard)[0])
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, data: memoryview) -> np.ndarray:
        """Write documents of sizes ids each; where each begins."""
        self.out.write(data)
        self.digest.update(data)
        self.ids.append(ids)
        self.sizes.append(sizes)
        starts = self.size + np.cumsum(sizes) - sizes
        self.size += int(sizes.sum())
        return starts

    def close(self) -> str:
        self.out.close()
        payload, table = _names(self.shard)
        self.files.store.move(self.temporary, self.files.path(payload))
        starts = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))]).astype("<i8")
        self.files.put(table, pack({"doc_ids": np.concatenate(self.ids).astype("<i8"), "starts": starts}))
        return self.digest.hexdigest()


def _batch(schema: str, *columns: np.ndarray | list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def shard_bytes(total: int) -> int:
    """Text of a shard: grows with the root of the total up to MOST_SHARD, so that small tables are written by several tasks as well."""
    return min(MOST_SHARD, max(LEAST_SHARD, int((total * (256 << 10)) ** 0.5)))


def _deal(rows: DataFrame) -> Deal:
    sizes = rows.select(F.col("doc_id").alias("id"), (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long").alias("n"))
    total, missing = (n or 0 for n in sizes.agg(F.sum("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")))).first())
    target = shard_bytes(total)
    return Deal(id_ranges(sizes.filter("id is not null"), target), target, missing)


def write_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> Store:
    """Encode docs (doc_id, text) by the tokenizer at that path and write them, each with end_id after it.

    Rows that share a doc_id and are dealt over several shards are so by their place in docs, which should be a table, or
    another input that gives its rows in the same order when a lost task reads it again.
    """
    spark = docs.sparkSession
    folder = folder or own_folder(spark, "ids")
    files = _Files(folder)
    files.store.create_dir(files.folder, recursive=True)
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
    kind = f"<u{width}"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    deal = _deal(rows)
    salted = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            ids, texts, h, place = batch.columns
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            keys = pc.fill_null(ids, NO_ID)
            shard = deal.of(keys.to_numpy(), missing, place.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(shard), keys, h, encoder.encode(texts, end_id, kind)], ["shard", "doc_id", "h", "ids"])

    encoded = salted.mapInArrow(encode, "shard int, doc_id long, h long, ids binary")
    dealt = encoded.repartitionById(deal.shards, "shard").sortWithinPartitions("shard", "doc_id", "h").drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer = _Files(folder), None

        def close() -> Iterator[pa.RecordBatch]:
            if writer:
                yield _batch(PLACE_SCHEMA, [writer.shard], [None], [None], [writer.size], [writer.close()])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, ids, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            ends = np.frombuffer(data.buffers()[1], "<i4", len(data) + 1 + data.offset)[data.offset :].astype(np.int64)
            body = memoryview(data.buffers()[2])
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if writer is None or writer.shard != shard[a]:
                    yield from close()
                    writer = _ShardWriter(own, int(shard[a]))
                sizes = np.diff(ends[a : b + 1]) // width
                starts = writer.add(ids[a:b], sizes, body[ends[a] : ends[b]])
                yield _batch(PLACE_SCHEMA, shard[a:b], ids[a:b], starts, sizes, [None] * (b - a))
        yield from close()

    places = stored(dealt.mapInArrow(write, PLACE_SCHEMA), "places")
    of_files = places.filter("sha256 is not null").select("shard", F.col("n").alias("n_tokens"), "sha256")
    of_docs = places.filter("sha256 is null").groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    of_docs.join(of_files, "shard").select("shard", "n_docs", "n_tokens", "first_id", "last_id", "sha256").write.parquet(f"{folder}/shards")
    shards = spark.read.parquet(f"{folder}/shards")
    _write_index(places, folder)
    files.tidy()
    return Store(folder, shards, spark.read.parquet(f"{folder}/buckets"), width)


def _bucket(n_buckets: int):  # noqa: ANN202
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int").alias("bucket")


def _write_index(places: DataFrame, folder: str) -> None:
    """The index files, and their manifest in folder/buckets."""
    first = F.min(F.struct("shard", "start", "n")).alias("first")
    keys = stored(places.filter("sha256 is null").groupBy("doc_id").agg(first, F.count(F.lit(1)).alias("rows")), "keys")
    n_buckets = max(1, -(-keys.count() // BUCKET_KEYS))
    dealt = keys.select(_bucket(n_buckets), "doc_id", "first.shard", "first.start", "first.n", "rows").repartitionById(n_buckets, "bucket")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Files(folder)
        table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        bucket, *columns = (c.to_numpy() for c in table.columns)
        for b in np.unique(bucket).tolist():  # one, where partitions are what they were asked to be
            data = build_bucket(*(c[bucket == b] for c in columns))
            own.put(f"keys-{b:06d}.mph", data)
            yield _batch(BUCKET_SCHEMA, [b], [int((bucket == b).sum())], [len(data)], [hashlib.sha256(data).hexdigest()])

    dealt.mapInArrow(build, BUCKET_SCHEMA).write.parquet(f"{folder}/buckets")


# reading


class _Reader:
    """Reads stretches of one file that lie close together, in ascending order, with few calls."""

    def __init__(self, files: _Files, name: str) -> None:
        self.file, self.low, self.held = files.store.open_input_file(files.path(name)), 0, b""

    def read(self, start: int, size: int) -> memoryview:
        if start < self.low or start + size > self.low + len(self.held):
            self.file.seek(start)
            self.low, self.held = start, self.file.read(max(size, READ_AHEAD))
        if start + size > self.low + len(self.held):
            raise ValueError("a shard is shorter than its index says")
        return memoryview(self.held)[start - self.low : start - self.low + size]


def find_keys(store: Store, keys: DataFrame) -> DataFrame:
    """Where the ids of keys (doc_id) are: shard, doc_id, start and n, a start of -1 for all rows of the id in that shard.

    Keys that the store doesn't hold give no row. Repeated keys are found once.
    """
    folder, n_buckets = store.folder, max(1, store.buckets.count())
    shards = store.shards.select("shard", "first_id", "last_id").orderBy("shard").collect()  # a row for each file
    numbers, firsts, lasts = (np.array(x, np.int64) for x in (zip(*shards, strict=True) if shards else ([], [], [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, number = _Files(folder), None, -1
        for batch in batches:
            bucket, ids = (c.to_numpy() for c in batch.columns)
            for b in np.unique(bucket).tolist():
                if b != number:
                    held, number = unpack(files.get(f"keys-{b:06d}.mph")), b
                own = ids[bucket == b]
                known, slot = find(held, own)
                own, rows = own[known], held["rows"][slot]
                one = rows == 1
                yield _batch(FOUND_SCHEMA, *(x[one] for x in (held["shard"][slot], own, held["start"][slot], held["n"][slot])))
                for key in own[~one].tolist():
                    across = numbers[np.searchsorted(lasts, key) : np.searchsorted(firsts, key, side="right")]
                    yield _batch(FOUND_SCHEMA, across, [key] * len(across), [-1] * len(across), [-1] * len(across))

    asked = keys.select(F.coalesce(keys["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
    return asked.select(_bucket(n_buckets), "doc_id").repartitionById(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND_SCHEMA)


def read_store(store: Store, keys: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (as bytes, four each) of keys (doc_id)."""
    folder, width = store.folder, store.width
    sizes = store.shards.select("shard", "n_tokens").orderBy("shard").collect()  # a row for each file
    bases, total = {}, 0
    for shard, n in sizes:
        bases[shard] = total
        total += n
    found = find_keys(store, keys)
    if not sizes:
        return found.limit(0).select("doc_id", "start", F.col("n").alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32"), F.lit(b"").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, reader, number, rows, held = _Files(folder), None, -1, [], 0
        for batch in batches:
            for shard, key, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != number:
                    reader, number = _Reader(files, _names(shard)[0]), shard
                wanted = [(start, n)]
                if start < 0:
                    table = unpack(files.get(_names(shard)[1]))
                    a, b = np.searchsorted(table["doc_ids"], key), np.searchsorted(table["doc_ids"], key, side="right")
                    wanted = zip(table["starts"][a:b].tolist(), np.diff(table["starts"][a : b + 1]).tolist(), strict=True)
                for at, size in wanted:
                    ids = np.frombuffer(reader.read(at * width, size * width), f"<u{width}").astype("<u4").tobytes()
                    rows.append((None if key == NO_ID else key, bases[shard] + at, size, zlib.crc32(ids), ids if with_ids else None))
                    held += len(ids) if with_ids else 0
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield _batch(READ_SCHEMA, *zip(*rows, strict=True))
                        rows, held = [], 0
        if rows:
            yield _batch(READ_SCHEMA, *zip(*rows, strict=True))

    last = sizes[-1][0] + 1
    return found.repartitionById(last, "shard").sortWithinPartitions("shard", "start").mapInArrow(run, READ_SCHEMA)
