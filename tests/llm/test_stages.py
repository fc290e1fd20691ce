"""Queries and pipeline stages on whole small tables, against SQL, brute force and plain code, and on odd and empty tables."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agoraspark.llm import bpe, chunks, langid, queries, simhash, weak_quality

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "pages", "conversations")


@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):
    """Folders of odd tables (nulls, repeats, clashing names) and of empty ones."""
    clash = {"spans": 1, "run_doc": 2, "row": 3, "extra_id": 4, "held_doc": 5, "votes": "v", "shingles": 6, "marked": "m"}
    more = spark.createDataFrame(
        [(1, "another text of the first id, which is not that of the other rows and goes on for some more words than they do", "en", "x"), (7, "der Hund lief über die Straße und sah das Haus an, in dem er wohnte, bis es dunkel wurde.", "de", "y"), (8, "日" * 3000, None, "z"), (9, "y" * 17 + "TAG" + "y" * 80, None, None)],
        "doc_id long, text string, lang string, source string",
    )
    docs = odd.select("doc_id", "text", "lang", "source").unionByName(more).withColumn("n_chars", F.char_length("text").cast("long"))
    docs = docs.withColumns({k: F.lit(v) for k, v in clash.items()})
    texts = docs.select("doc_id", "text")
    made = {
        "documents": docs,
        "benchmark": texts.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 60).alias("text"), F.lit(1).alias("view"), F.lit(2).alias("w")).filter("item_id is null or item_id in (1, 2, 3)"),
        "labels": spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, None, None), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"),
        "pages": texts.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), F.lit("p").alias("payload"), F.lit("d").alias("digest")),
        "conversations": texts.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.when(F.col("doc_id") > 2, "user").alias("role"), "text", F.lit("t").alias("turns"), F.lit("r").alias("record")),
    }
    base = tmp_path_factory.mktemp("tables")
    for name, df in made.items():
        df.write.parquet(f"{base}/odd/{name}.parquet")
        df.limit(0).write.parquet(f"{base}/empty/{name}.parquet")
    return base


SOURCES = {"op4_warc": "pages", "op6_chat": "conversations"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_odd_and_empty_tables(spark, tables, name):
    for kind in ("odd", "empty"):
        got = queries.QUERIES[name](spark, f"{tables}/{kind}")
        n = got.count()
        source = spark.read.parquet(f"{tables}/{kind}/{SOURCES.get(name, 'documents')}.parquet")
        if name == "op6_chat":
            assert n == source.select("conv_id").distinct().count() + 1  # and conversation -7
        elif name == "op11_lexical_search":
            assert n <= 20 * spark.read.parquet(f"{tables}/{kind}/benchmark.parquet").distinct().count()
        elif name == "op13_filter_audit":
            assert n == 600 * source.select(F.coalesce("lang", F.lit(""))).distinct().count()
        elif name in ("op3_templates", "op9_chunk_dedup"):
            assert n <= source.count()
        else:
            assert n == source.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_and_empty_tables(spark, tables, kind):
    docs = spark.read.parquet(f"{tables}/{kind}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, f"{tables}/{kind}")
        assert got.count() <= docs.count()
        if name != "tokens":
            assert got.columns == docs.columns
            # all that a stage keeps it keeps as it was, but for text that repeated_passages cuts
            if name != "repeated_passages":
                assert got.exceptAll(docs).count() == 0
    assert corpus_pipeline.run(spark, f"{tables}/{kind}").count() <= docs.count()


def test_run_is_its_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert sorted(docs.select("doc_id", "ids_sha256").collect()) == sorted(corpus_pipeline.run(spark, DATA).select("doc_id", "ids_sha256").collect())


def test_quality_keeps_what_it_scores(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in weak_quality.keep_good(docs).collect()}
    assert kept == {r["doc_id"] for r in weak_quality.quality_scores(docs).filter("keep").collect()} and 0 < len(kept) < docs.count()


def shingles(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def pairs_of(similarities, rng):
    """Pairs of texts of which the second has words changed as long as the similarity stays at the given one or above."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    for least in similarities:
        a = [word() for _ in range(rng.choice([60, 150, 300]))]
        own, best = shingles(" ".join(a)), list(a)
        while True:
            tried = list(best)
            tried[rng.randrange(len(a))] = word()
            theirs = shingles(" ".join(tried))
            if len(own & theirs) < least * len(own | theirs):
                break
            best = tried
        theirs = shingles(" ".join(best))
        yield " ".join(a), " ".join(best), len(own & theirs) / len(own | theirs)


def test_near_groups_against_exact_similarity(spark):
    made = list(pairs_of([s for s in (0.7, 0.75, 0.79, 0.8, 0.85, 0.9) for _ in range(40)], random.Random(11)))
    rows = [(2 * i + k, t) for i, pair in enumerate(made) for k, t in enumerate(pair[:2])]
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [group[2 * i + 1] == 2 * i for i in range(len(made))]
    near = [x for x, (_, _, s) in zip(linked, made, strict=True) if s >= 0.8]
    assert np.mean(near) >= 0.9 and not any(x for x, (_, _, s) in zip(linked, made, strict=True) if s < 0.8)
    assert all(group[2 * i] == 2 * i for i in range(len(made)))


def test_near_groups_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_LIMIT", 20)
    monkeypatch.setattr(simhash, "HOT_PARTNERS", 5)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    seeds = [[word() for _ in range(200)] for _ in range(3)]
    rows = []
    for i in range(150):
        text = list(seeds[i % 3])
        text[rng.randrange(200)] = word()
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(word() for _ in range(100))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(docs).collect()}
    assert all(group[i] == i % 3 for i in range(150)) and all(group[1000 + i] == 1000 + i for i in range(20))
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == {0, 1, 2, *range(1000, 1020)}


def test_near_duplicates_are_decided_by_row(spark):
    same, other = "one text that is here twice and has some words", "quite another text of the same id that nobody else has"
    docs = spark.createDataFrame([(1, same), (2, same), (2, other), (None, same), (3, ""), (4, None), (1, same)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.drop_near_duplicates(docs).collect())
    assert got == [(0, same), (1, same), (1, same), (2, other), (3, "")]


def brute_runs(rows, min_words=chunks.MIN_WORDS):
    """What is left of each text, by a dictionary of chunks in the order of rows (id and text apart)."""
    import xxhash

    seen, out = {}, {}
    for key, raw in rows:
        ends, words = chunks.chunk_ends(np.frombuffer(raw, np.uint8))
        begin, marks, own = 0, [], set()
        for end, n in zip(ends.tolist(), words.tolist(), strict=True):
            digest = xxhash.xxh3_64_intdigest(raw[begin:end].strip())
            marks.append((begin, end, n, digest in own or digest in seen))
            own.add(digest)
            begin = end
        for d in own:
            seen.setdefault(d, key)
        left, i = b"", 0
        while i < len(marks):
            j = i
            while j < len(marks) and marks[j][3]:
                j += 1
            if j > i and sum(m[2] for m in marks[i:j]) >= min_words:
                i = j
                continue
            j = max(j, i + 1)
            left += b"".join(raw[m[0] : m[1]] for m in marks[i:j])
            i = j
        out[key] = left if marks else raw
    return out


def test_chunks_against_a_dictionary(spark, monkeypatch):
    monkeypatch.setattr(chunks, "HOT_DOCUMENTS", 4)
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    cjk = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    passages = [say(60), say(200), cjk(5000), "z" * 3000]
    texts = {}
    for i in range(60):
        parts = [say(rng.randrange(5, 60))] + [p for p in passages if rng.random() < 0.4] + [cjk(rng.randrange(0, 200)) + say(rng.randrange(1, 30))]
        rng.shuffle(parts)
        texts[i] = " ".join(parts)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts.items()], "doc_id long, text string, spans int, run_doc int, run_row int")
    want = brute_runs([(i, t.encode()) for i, t in texts.items()])
    got = {r["doc_id"]: r["text"] for r in chunks.remove_runs(docs).collect()}
    assert chunks.remove_runs(docs).columns == docs.columns
    assert got == {i: t.decode() for i, t in want.items() if t.strip()}
    whole, held = passages[2], " ".join(got.values())
    assert sum(whole in t for t in texts.values()) > 5 and sum(whole in t for t in got.values()) == 1
    assert len(held) < 0.7 * sum(map(len, texts.values()))


def test_chunks_of_rows_that_share_an_id(spark):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared, alone = say(150), say(160)
    rows = [(1, shared), (2, "zzz " + shared), (2, alone), (None, alone + " end"), (2, alone)]
    got = sorted(((r["doc_id"] or 0), len(r["text"])) for r in chunks.remove_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the row without id comes first; both rows of id 2 that repeat it are cut alike
    assert (0, len(alone) + 4) in got and (1, len(shared)) in got and sum(n < 60 for i, n in got if i == 2) == len([n for i, n in got if i == 2])


def test_long_pieces_leave_in_time():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine, rng = bpe.codec(path, P.PATTERN).machine, random.Random(6)
    for letters in ("etaoinshrdlu", "ab", "a", "=", "éß日本e"):
        piece = "".join(rng.choice(letters) for _ in range(60_000)).encode()
        given, out, left = 0, 0, 0

        def blocks(piece=piece):
            nonlocal given
            for i in range(0, len(piece), 512):
                given = i + len(piece[i : i + 512])
                yield piece[i : i + 512]

        ids = []
        for token in machine.stream(blocks()):
            ids.append(token)
            out += machine.sizes[token]
            left = max(left, given - out)
        assert out == len(piece) and left < 1200
        assert ids == library._core_bpe.encode_single_piece(piece) and machine.encode_piece(piece) == ids


def test_utf8_table_against_the_library():
    rng = random.Random(3)
    some = b"\xe2\x82\xac\xf0\x9f\x98\x80\xc3\xa9\xed\xa0\x80\xc0\xf5\xf4\x90"
    for _ in range(5000):
        data = bytes(rng.choice([rng.randrange(256), rng.choice(some), 65]) for _ in range(rng.randrange(12)))
        stream, out, i = bpe.Utf8Stream(), "", 0
        while i < len(data):
            n = rng.randrange(1, 4)
            out += stream.feed(data[i : i + n])
            i += n
        assert out + stream.finish() == data.decode("utf-8", "replace")


def test_language_ties_and_its_fit(spark):
    docs = spark.createDataFrame([(i, "same words here" if i % 2 else "autres mots ici", "en" if i % 2 else "fr") for i in range(60)] + [(100, "xqz", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(60)) and got[100]["lang_pred"] in ("en", "fr")
    assert langid.softmax(np.zeros((1, 2)))[0].argmax() == 0  # of equal probabilities the first


def test_folder_must_be_shared(spark, monkeypatch):
    from agoraspark.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Session())


def test_stored_tables_are_removed(spark, tmp_path):
    from agoraspark.llm import common

    before = list(common._STORED)
    common._STORED.clear()
    kept = common.stored(spark.range(5), "kept")
    path = re.sub("^file:", "", kept.inputFiles()[0]).rsplit("/", 1)[0].replace("///", "/")
    import os

    assert kept.count() == 5 and os.path.isdir(path)
    common.discard_stored()
    assert not os.path.isdir(path)
    common._STORED.extend(before)
