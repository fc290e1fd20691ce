"""Binary shards of token ids and their index: against the library, a dictionary, and plain sums."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agoraspark.llm import ranges, token_store

DATA = "/root/testdata/sf0.001"
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = ["", " ", "a", "0", "0 0", "10 times 0.5", "a\x0bb\x0cc\x1cd\x85e f g", "ΟΔΟΣ Σ ΑΣ.", "é ́x", "<|endoftext|> x<|startoftext|>y", "don't we'll I'M", "日本語 🙂🙂 ünï", "x" * 30000, " 0", "٠० ⅷ 00", "#", "\n\n#\t#", "Word. word.. ÉTÉ, éte. don.t word., .word word.0 ŉ. ſ. ß."]


def test_words_against_the_library(spark, library):
    encoder = token_store.Encoder(PATH)
    texts = [*ODD, None, *(r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())]
    for end_id, kind in ((2, "<u2"), (49407, "<u4")):
        got = encoder.encode(pa.array(texts, pa.string()), end_id, kind)
        for text, ids in zip(texts, got.to_pylist(), strict=True):
            assert np.frombuffer(ids, kind).tolist() == [*library(text), end_id]
    part = pa.array(texts, pa.string()).slice(3, 5)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(part, 2, "<u2").to_pylist()] == [[*library(t), 2] for t in texts[3:8]]


def test_words_that_are_forgotten(monkeypatch, library):
    monkeypatch.setattr(token_store, "CACHED_UNITS", 2)
    monkeypatch.setattr(token_store, "SLICE_WORDS", 3)
    encoder = token_store.Encoder(PATH)
    for text in ("One two three. two", "three four five, one ONE", "six seven eight nine ten one two three four", "one"):
        assert np.frombuffer(encoder.encode(pa.array([text]), 2, "<u2")[0].as_py(), "<u2").tolist() == [*library(text), 2]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 40000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(-(2**63), 2**63, n // 2, np.int64), np.arange(n - n // 2)]))
    index = token_store.build_hash(keys)
    assert sorted(token_store.slots(index, keys).tolist()) == list(range(len(keys)))
    bucket = token_store.unpack(token_store.build_bucket(keys, keys % 7, keys, keys * 0 + 3, keys * 0 + 1))
    known, slot = token_store.find(bucket, keys)
    assert known.all() and (bucket["start"][slot] == keys).all() and (bucket["shard"][slot] == keys % 7).all()
    absent = np.setdiff1d(rng.integers(-(2**63), 2**63, 5000, np.int64), keys)
    assert not token_store.find(bucket, absent)[0].any()


def plain(rows, library):
    """doc_id, start, n_tokens, ids_crc32 where rows of one doc_id may be in any order."""
    coded = sorted(((d is not None, d or 0, np.array([*library(t), 2], "<u4").tobytes()) for d, t in rows), key=lambda r: r[:2])
    start, by_id = 0, {}
    for known, d, ids in coded:
        by_id.setdefault(d if known else None, [start, []])[1].append(ids)
        start += len(ids) // 4
    return by_id


def check(store, keys, rows, library):
    want = plain(rows, library)
    got = {}
    for r in token_store.read_store(store, keys).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for d, found in got.items():
        start, ids = want[d]
        found.sort()
        assert Counter(x for _, x in found) == Counter(ids)
        for at, x in found:
            assert at == start
            start += len(x) // 4
    return set(got)


@pytest.mark.parametrize("size", [1, 3000, 64 << 20])
def test_store(spark, library, monkeypatch, odd, size):
    monkeypatch.setattr(token_store, "shard_bytes", lambda total: max(size, 500))
    monkeypatch.setattr(token_store, "BUCKET_KEYS", 37)
    monkeypatch.setattr(token_store, "READ_AHEAD", 64)
    hot = spark.range(40).select(F.lit(77).cast("long").alias("doc_id"), F.concat(F.lit("a text of the hot id "), F.col("id") % 3).alias("text"))
    hot = hot.union(spark.range(20).select(F.lit(None).cast("long"), F.lit("none has an id")))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") * 1000003 - 5).alias("doc_id"), "text").limit(60 if size == 1 else 200)
    docs = docs.unionByName(odd.select("doc_id", "text")).unionByName(hot).withColumn("start", F.lit("s")).repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    store = token_store.write_store(docs, PATH, 2)
    assert check(store, docs, rows, library) == {r[0] for r in rows}
    some = spark.createDataFrame([(77,), (77,), (1,), (123456789,), (None,), (-17,)], "doc_id long")
    assert check(store, some, rows, library) == {77, 1, None}
    shards = store.shards.orderBy("shard").collect()
    assert all(a["last_id"] <= b["first_id"] for a, b in zip(shards, shards[1:], strict=False))
    assert sum(r["n_docs"] for r in shards) == len(rows) and (len(shards) > 5) == (size < 1 << 20)
    if size < 3000:
        assert len([r for r in shards if r["first_id"] == r["last_id"] == 77]) > 1
    files = token_store._Files(store.folder)
    names = [f.base_name for f in files.store.get_file_info(token_store.fs.FileSelector(files.folder))]
    assert not [x for x in names if x.startswith(".")] and len([x for x in names if x.endswith(".bin")]) == len(shards)


def test_empty_store(spark, empty, odd):
    store = token_store.write_store(empty, PATH, 2)
    assert token_store.read_store(store, odd).collect() == []
    full = token_store.write_store(odd, PATH, 2)
    assert token_store.read_store(full, empty).collect() == []


def test_ranges(spark):
    sizes = spark.createDataFrame([(i * i, 1 + i % 7) for i in range(500)] + [(90000, 5000)], "id long, n long")
    found = ranges.id_ranges(sizes, 100)
    assert sum(n for _, n in found) == 5000 + sum(1 + i % 7 for i in range(500)) and sorted(found) == found
    assert [x for x in found if x[1] > 100] == [(90000, 5000 + 1 + 300 % 7)]
    deal = ranges.Deal(found, 100, missing=250)
    ids = np.array([-9, 0, 90000, 90000, 90001, 10**9])
    got = deal.of(ids, np.array([True, False, False, False, False, False]), np.array([4, 4, 4, 5, 6, 7]))
    assert got[0] == 1 and got[1] == 3 and got[2] != got[3] and (np.diff(got[1:]) != 0).sum() >= 2 and got.max() < deal.shards
