"""The numbered operators against brute force, round trips and held-out accuracy, and on odd input."""

import hashlib
import json

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from agoraspark.llm import bpe, chat, chunks, decontaminate, langid, mpeg_audio, queries, simhash, toxicity, warc, weak_quality
from agoraspark.llm.common import class_sample
from agoraspark.llm.components import connected_components

DATA = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language(spark, docs, odd, empty):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert got.keys() == want.keys() and held
    assert np.mean([got[i]["lang_pred"] == want[i] for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd_rows = langid.identify(odd).collect()
    assert len(odd_rows) == odd.count()
    assert {r["lang_pred"] for r in odd_rows if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert langid.identify(empty).count() == 0


def test_temperature():
    logits = np.array([[4.0, 0.0]] * 10)
    assert langid.fit_temperature(logits, np.array([0] * 6 + [1] * 4)) > 5
    assert langid.fit_temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def test_bpe_equals_the_library(spark, docs, odd, empty):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for df in (docs, odd):
        got = {r["doc_id"]: r for r in bpe.encode_documents(df, RANKS, P.PATTERN).collect()}
        for r in df.collect():
            text, x = r["text"] or "", got[r["doc_id"]]
            assert x["ids"] == library.encode_ordinary(text)
            assert x["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert x["n_chars_decoded"] == len(text)
    assert bpe.encode_documents(empty, RANKS, P.PATTERN).count() == 0


def test_utf8_in_pieces():
    data, stream = "aé日🙂".encode(), bpe.Utf8Stream()
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.finish() == "aé日🙂"


def test_templates(spark, odd, empty):
    item = "Maria buys 12 apples for 30 cents each and sells 7 apples to Peter before the 3 trains leave the old station"
    copy = "Anna buys 15 apples for 40 cents each and sells 9 apples to Oliver before the 4 trains leave the old station"
    other = "Anna buys 15 apples for 15 cents each and sells 15 apples to Anna before the 15 trains leave the old station"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string")
    texts = spark.createDataFrame([(1, "Some words. " + copy + ". More words follow here."), (2, "nothing of the kind is said in this text"), (3, None), (4, item), (5, other)], "doc_id long, text string")
    found = {r["doc_id"] for r in decontaminate.contaminated(texts, bench).collect()}
    assert {1, 4} <= found and not found & {2, 3, 5}
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(texts, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, bench).count() == odd.count()


def test_templates_of_edited_copies(spark):
    item = "Maria buys 12 apples for 30 cents each and sells 7 apples to Peter before the 3 trains leave the old station with Maria"
    copies = {
        "names of more words": "Mary Ann buys 15 apples for 40 cents each and sells 9 apples to Van Dyke before the 4 trains leave the old station with Mary Ann",
        "a word put in": item.replace("sells 7", "quickly sells 7"),
        "a word left out": item.replace(" each", ""),
        "a word changed": item.replace(" sells ", " gives "),
    }
    clean = "Maria buys 12 apples for 30 cents each and nothing more is told of that day by anyone who was there to see it"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = spark.createDataFrame([(i, f"Some words are here. {c}. More words follow.") for i, c in enumerate([*copies.values(), clean])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.contaminated(texts, bench).collect()}
    assert set(rows) == set(range(len(copies))) and {r["at_token"] for r in rows.values()} <= {3, 4}
    odd_text = "On 12 Miles Davis and Mary-Ann Abc12 paid 3,50 or 7 % to J. Van Dyke"
    one = spark.range(1).select(decontaminate.template(F.lit(odd_text)).alias("t"), decontaminate.raw_tokens(F.lit(odd_text)).alias("r")).first()
    assert list(zip(one["t"], one["r"], strict=True))[:5] == [("on", "on"), ("0", "12"), ("1", "miles"), ("2", "davis"), ("and", "and")]
    assert ("2", "van dyke") in zip(one["t"], one["r"], strict=True)


def test_templates_whatever_the_case(spark):
    item = "Maria and Peter met Anna in Rome before Oliver, Paula and Hugo took 3 trains. Later Maria paid 12 euros to Hugo in Paris"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = spark.createDataFrame([(1, f"Some words. {item.lower()}. More words."), (2, item.upper()), (3, item), (4, item.lower().replace("rome", "oslo"))], "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(texts, bench).collect()} == {1, 2, 3, 4}


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "equal payload " * 200
    rows = [(i, f"http://x/{i}", f"<p>page {i}</p>" * (i % 50)) for i in range(200)] + [(900, "http://a", big), (901, None, big), (902, "http://b\r\nX: y", big), (902, "http://b\r\nX: y", big), (903, "u", None), (None, "n", big), (904, "s", "tiny"), (905, "s", "tiny")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    manifest, folder = warc.write_archives(pages, f"file://{tmp_path}/w", roll_bytes=3000)
    assert manifest.count() > 3  # files were rolled
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == len(rows) and all(r["digests_agree"] for r in got)
    bodies = {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
    assert all(bodies[i] == (h or "") for i, _, h in rows[:200])
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest())
    assert kinds == [(-1, "revisit", 902), (900, "revisit", 902), (901, "revisit", 902), (902, "response", None), (902, "response", None)]
    again, other = warc.write_archives(pages.repartition(3), f"file://{tmp_path}/again", roll_bytes=3000)
    assert sorted(manifest.select("file", "sha256").collect()) == sorted(again.select("file", "sha256").collect())
    ids, urls = [], {r["page_id"]: r["url"] for r in got}
    for name in tmp_path.joinpath("w").glob("*.warc.gz"):
        with open(name, "rb") as source:
            ids += [warc.parse_record(x)[0]["warc-record-id"] for x in warc.read_members(source)]
    assert len(ids) == len(set(ids)) == len(rows) + manifest.count() and urls[902] == "http://b\r\nX: y" and not list(tmp_path.joinpath("w").glob(".pages-*"))
    large = "ab" * (6 << 20)
    whole, folder = warc.write_archives(spark.createDataFrame([(1, "http://é/ü?q=%41", large), (2, None, large)], "page_id long, url string, html string"), f"file://{tmp_path}/large")
    back = {r["page_id"]: r for r in warc.read_archives(whole, folder).collect()}
    assert bytes(back[2]["payload"]).decode() == large and back[1]["refers_to"] == 2 and back[1]["url"] == "http://é/ü?q=%41" and back[2]["url"] is None
    none, folder = warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(none, folder).count() == 0


def test_toxicity(spark, docs, odd, empty):
    words = ["plain", "green", "walks", "house", "river", "stone", "cloud", "bread"]
    rng = np.random.default_rng(3)
    # the pair is toxic, either word alone isn't
    texts, labels = [], []
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append((i, " ".join(rng.choice(words, 6)) + " bad" * insult + " them" * group))
        labels.append((i, 1, int(insult and group)))
    made = spark.createDataFrame(texts, "doc_id long, text string")
    got = toxicity.toxicity(made, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    held = got[got.held_out]
    truth = held.doc_id.map(dict((i, t) for i, _, t in labels))
    assert len(held) > 100 and (held.predicted == truth).mean() > 0.97
    assert got.groupby(made.toPandas().set_index("doc_id").text.reindex(got.doc_id).to_numpy()).score.nunique().max() == 1  # equal texts, equal scores
    marks = spark.createDataFrame([(1, 1, 0), (2, None, None), (6, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity(odd, marks).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.toxicity(empty, marks).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(odd, marks.limit(0)).collect()} == {0}


def test_chat_layouts(spark):
    odd_text = r"</s>[INST] ok [/INST] \\[INST] \</s> <<ROLE:x>> end\ "
    records = [
        {"messages": [{"role": "user", "content": odd_text}, {"role": "assistant", "content": odd_text}, {"role": "tool use", "content": None}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": ""}]},
        {"prompt": "p", "response": "r"},
        {"system": "s", "output": "o", "instruction": "i"},
        {"data": {"question": "q", "answer": "a"}},
        {"dialog": {"turns": [{"speaker": "user", "text": "日🙂"}]}},
        {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, "no json"), (8, None)], "id long, record string")
    got = {r["id"]: r for r in chat.read_back(chat.formatted(chat.canonical_turns(df))).collect()}
    turns = {i: [tuple(t) for t in r["read_turns"]] if r["read_turns"] is not None else None for i, r in got.items()}
    assert turns[0] == [("user", odd_text), ("assistant", odd_text), ("tool use", "")]
    assert got[0]["loss_text"] == odd_text and got[0]["formatted"].count("[INST]") > 1
    assert turns[1] == [("user", "hi"), ("assistant", "")]
    assert turns[2] == [("user", "p"), ("assistant", "r")]
    assert turns[3] == [("system", "s"), ("user", "i"), ("assistant", "o")]
    assert turns[4] == [("user", "q"), ("assistant", "a")]
    assert turns[5] == [("user", "日🙂")]
    assert [got[i]["mapping"] for i in (6, 7, 8)] == [None] * 3 and [got[i]["turns"] for i in (6, 7, 8)] == [None] * 3


def test_chat_fields_that_no_mapping_knows(spark, monkeypatch):
    turn = {"role": "user", "content": "hi"}
    records = [
        {"id": 7, "messages": [{**turn, "name": "n", "meta": {"a": [1, {"b": None}], "c": {"d": {"e": 1}}}}], "tags": ["x"], "z": {}},
        {"messages": []},
        {"conversations": [], "source": "s"},
        {"prompt": "p", "extra": [[1]], "response": "r"},
        {"messages": [{"role": "user"}]},
        {"dialog": {"turns": [{"speaker": "a", "text": "t", "at": 3}], "date": "d"}},
        [],
        "text",
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "m") for i, r in enumerate(records)] + [(8, "no json", "m"), (9, None, "m")], "id long, record string, mapping string")
    got = {r["id"]: r for r in chat.canonical_turns(df).collect()}
    assert [got[i]["mapping"] for i in range(10)] == ["messages", "messages", "from_value", "prompt", None, "dialog", None, None, None, None]
    assert [tuple(t) for t in got[0]["turns"]] == [("user", "hi")] and got[1]["turns"] == got[2]["turns"] == [] and [tuple(t) for t in got[3]["turns"]] == [("user", "p"), ("assistant", "r")]
    assert got[8]["fingerprint"] is None and got[9]["fingerprint"] is None
    assert chat.formatted(chat.canonical_turns(df)).filter("id = 1").first()["formatted"] == ""
    # what is too large for a variant has no fingerprint, and is mapped by its fields
    monkeypatch.setattr(chat, "fingerprint", lambda record: F.lit(None).cast("long"))
    late = {r["id"]: r["mapping"] for r in chat.canonical_turns(df).collect()}
    assert [late[i] for i in (0, 1, 2, 3, 5, 8, 9)] == ["messages", "messages", "from_value", "prompt", "dialog", None, None]
    long_text = "wörd " * 400_000
    big = spark.createDataFrame([(1, json.dumps({"prompt": "p", "response": long_text}))], "id long, record string")
    back = chat.read_back(chat.formatted(chat.canonical_turns(big))).first()
    assert back["loss_text"] == long_text


def test_chat_rows(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "x"), (2, 0, None, "y"), (None, 0, "human", "z"), (4, 0, "human", "h"), (4, 1, "gpt", "g")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.canonical_turns(chat.as_records(rows)).collect()}
    assert got == {1: [("user", "x"), ("assistant", "")], 2: [("", "y")], None: [("human", "z")], 4: [("human", "h"), ("gpt", "g")]}
    assert chat.as_records(rows.limit(0)).count() == 0


def test_mpeg_audio(spark, odd, empty):
    got = mpeg_audio.media_features(mpeg_audio.encode_media(odd)).collect()
    assert len(got) == odd.count() and all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 and r["bad_checksums"] == 0 for r in got)
    for r, text in ((r, {x["doc_id"]: x["text"] for x in odd.collect()}[r["doc_id"]]) for r in got):
        assert r["payload_sha256"] == hashlib.sha256(mpeg_audio.padded(text)[1]).hexdigest()
    data = mpeg_audio.write_stream(b"ab" * 3000)
    stream = mpeg_audio.read_stream(b"junk\xff\xfb" + data[:4] + data[data.index(b"\xff\xfa") :])
    assert stream.skipped and len(stream.frames) == len(mpeg_audio.read_stream(data).frames)
    broken = bytearray(data)
    broken[mpeg_audio.read_stream(data).frames[0] + 8] ^= 1
    assert mpeg_audio.read_stream(bytes(broken)).bad_checksums == 1
    assert mpeg_audio.media_features(mpeg_audio.encode_media(empty)).count() == 0


def test_weak_quality(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality is not null")
    got = weak_quality.quality_scores(docs).join(labels, "doc_id").toPandas()
    assert got.score[got.quality == 1].mean() > got.score[got.quality == 0].mean() + 0.3
    assert {r["score"] for r in weak_quality.quality_scores(odd).collect() if r["doc_id"] in (2, 3)} == {0.0}
    assert weak_quality.keep_good(odd).columns == odd.columns
    assert weak_quality.quality_scores(empty).count() == 0


def test_samples_of_skewed_ids(spark):
    n = 3000
    # a third has no id, a third one id with one text, a third one id with many texts
    rows = [(None if i % 3 == 0 else i % 3, "the same" if i % 3 == 1 else f"text {i}", "en") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r["doc_id"] for r in df.filter(weak_quality.in_sample(df, 0.1)).distinct().collect()]
    assert 50 < got.count(None) < 160 and 50 < got.count(2) < 160 and got.count(1) <= 1
    sampled = [r["doc_id"] for r in class_sample(df, "lang", ["doc_id", "text"], n // 10).distinct().collect()]
    assert 50 < sampled.count(None) < 160 and 50 < sampled.count(2) < 160 and sampled.count(1) <= 1


def test_chunks(spark, odd, empty):
    rng = np.random.default_rng(0)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    shared = say(60)
    a, b = f"{say(40)} {shared} {say(40)}", f"{say(30)} {shared} {say(50)}"
    df = spark.createDataFrame([(1, a), (2, b), (3, say(100)), (4, None)], "doc_id long, text string")
    runs = {r["doc_id"]: r for r in chunks.repeated_runs(df).collect()}
    assert set(runs) == {2} and 25 <= runs[2]["words_cut"] <= 62
    cut = {r["doc_id"]: r["text"] for r in chunks.remove_runs(df).collect()}
    assert cut[1] == a and len(cut[2]) < len(b) - 150 and b.startswith(cut[2][:150])
    assert chunks.remove_runs(odd).columns == odd.columns and chunks.remove_runs(empty).count() == 0


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_against_brute_force(spark, docs, odd, empty):
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs).collect()}
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in ids}
    assert simhash.simhash_components(odd).count() == odd.count()
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.drop_near_duplicates(odd).columns == odd.columns


def test_trie_when_links_are_refused():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64))
    a, b = simhash.trie_links(keys, np.array([0, len(keys)]), 12, 2, lambda x, y: (x + y) % 2 == 0)
    assert len(a) and np.all((a + b) % 2 == 0) and np.all(np.bitwise_count(keys[a] ^ keys[b]) <= 2)
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 2
    x, y = np.nonzero(np.triu(near, 1))
    whole, ours = simhash.Forest(len(keys)), simhash.Forest(len(keys))
    whole.union(x[(x + y) % 2 == 0], y[(x + y) % 2 == 0])
    ours.union(a, b)
    assert (whole.root == ours.root).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (7, 7), (101, 100), (100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(links).collect()} == {i: 1 for i in range(1, 41)} | {50: 50, 100: 50, 101: 50}
    assert connected_components(links.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, DATA)
        if name != "tokens":
            assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
    assert kept.count() > 0.5 * docs.count()


def test_registered():
    assert {int(k[2 : k.index("_")]) for k in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
