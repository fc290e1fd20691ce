"""What is computed for a text depends on that text alone; trained models see what only pairs or whole texts show."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from agoraspark.llm import decontaminate, langid, mpeg_audio, textvec, toxicity, weak_quality

ODD = ["on", "", "x", "hello", "...", "!! a", "Zwölf Boxkämpfer", "日本語 テキスト", "🙂 𐐷𐐨 b", " lead", "trail ", "A-B  c", "1 2 3", "a" * 50, "The end.\nNew line", "-", "é"]


def features_of(texts):
    """All features of each text, as the modules compute them for a list of texts."""
    out = []
    for block in textvec.blocks(texts, 60):  # small blocks, so that texts meet block edges
        grams = [(a.tobytes(), n.tobytes()) for a, n in langid.gram_counts(block)]
        m = weak_quality.measures(block)
        shapes = [(a.tobytes(), x.tobytes()) for a, x in weak_quality.features(block, m)]
        owner, term = toxicity.terms(block)
        for i in range(block.n):
            out.append((grams[i], tuple(float(v[i]) for v in m.values()), weak_quality.patterns_of(m)[i], shapes[i], term[owner == i].tobytes()))
    return out


def test_neighbours_do_not_matter():
    alone = {t: features_of([t])[0] for t in ODD}
    rng = random.Random(4)
    for _ in range(150):
        texts = [rng.choice(ODD) for _ in range(rng.randrange(1, 12))]
        assert [alone[t] for t in texts] == features_of(texts)
    # h e l o; " h" he el ll lo "o "; " he" hel ell llo "lo "
    assert len(list(langid.gram_counts(next(textvec.blocks(["hello"]))))[0][0]) == 4 + 6 + 5


def test_results_do_not_change_with_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    same = docs.unionByName(spark.createDataFrame([(1000 + i, "on", "en") for i in range(40)], docs.schema))
    for run in (langid.identify, weak_quality.quality_scores):
        first, second = (sorted(map(str, run(df).collect())) for df in (same, same.orderBy(F.xxhash64("doc_id")).repartition(7)))
        assert first == second
    assert langid.identify(same).filter("doc_id >= 1000").select("lang_pred", "score").distinct().count() == 1


@pytest.mark.parametrize(("share", "n"), [(0.2, 6000), (0.05, 60000)])
def test_pairs_that_say_nothing_alone(share, n):
    """Both words are toxic, one alone never, neither so often that no word goes with the label: only factors can tell."""
    rng, base = np.random.default_rng(7), share / (1 - share)
    rows, label = [], []
    for _ in range(n):
        insult, group = rng.random(2) < share
        rows.append(np.unique(np.concatenate([rng.integers(2, 800, 8), [0] * int(insult), [1] * int(group)])).astype(np.int64))
        label.append(int(insult and group) if insult or group else int(rng.random() < base))
    label, held = np.array(label), np.arange(n) % 5 == 0
    train = np.flatnonzero(~held)
    train = np.concatenate([rng.permutation(train[label[train] == y])[:4000] for y in (0, 1)])
    own = toxicity.frequent([rows[i] for i in train])
    place = lambda r: (at := toxicity.places(own, r))[at >= 0]
    both = [i for i in np.flatnonzero(held) if rows[i][0] == 0 and rows[i][1] == 1]
    shift = np.log(label.mean() / (1 - label.mean())) - np.log(label[train].mean() / (1 - label[train].mean()))
    caught = {}
    for factors in (True, False):
        bias, w, v = toxicity.fit_machine([place(rows[i]) for i in train], label[train], len(own), factors)
        y, _ = toxicity.Rows([place(rows[i]) for i in both]).predict(bias + shift, w, v)
        caught[factors] = (y >= 0).mean()
    assert len(both) >= 15 and caught[True] > 0.9 and caught[False] < 0.3


def test_audio_of_texts_that_look_like_tags_or_frames():
    marks = [b"TAG", b"ID3\3\0\0\0\0\0\x10", b"Xing" + struct.pack(">III", 7, 3, 9), b"Info" + struct.pack(">I", 1), b"VBRI", b"\xff\xfb\x90\xc4", b"\xff\xfa\xe4\xc4" * 3]
    for size in [*range(1, 130, 7), 100, 521, 576, 958, 1458, 1500, 1900, 2000]:
        for mark in marks:
            for at in range(0, size, 1 if size < 100 or size in (576, 1500) else 13):
                raw = (b"x" * at + mark + b"y" * size)[:size]
                payload = raw + b"\0" * (-len(raw) % 64)
                data = mpeg_audio.write_stream(payload)
                stream = mpeg_audio.read_stream(data)
                assert mpeg_audio.payload_of(data, stream) == payload and not stream.skipped and not stream.bad_checksums, (size, mark, at)


def test_audio_query_against_plain_values(spark):
    texts = {1: "", 2: "x" * 17 + "TAG" + "y" * 80, 3: "日本" * 700, 4: None, 5: "a" * 64}
    rows = mpeg_audio.media_features(mpeg_audio.encode_media(spark.createDataFrame([(i, t, "clash", 3) for i, t in texts.items()], "doc_id long, text string, media string, feature int"))).collect()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        body = raw + b"\0" * ((-len(raw) % 64) if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        data = mpeg_audio.write_stream(body)
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        # a walk from header to header, apart from the reader: kbit/s from the third byte, 3 bytes a frame for each at 48 kHz
        at, offsets = data.index(b"\xff\xfa"), []
        kbps = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
        while at < len(data):
            offsets.append(at)
            at += 3 * kbps[data[at + 2] >> 4]
        assert r["seek_offsets"] == offsets[1:] and r["n_frames"] == len(offsets) - 1 and r["duration_ms"] == 24.0 * r["n_frames"]
        assert f"samples={1152 * r['n_frames']};" in r["feature"]


def bit_crc(bits):
    value = 0xFFFF
    for bit in bits:
        value = (value << 1 & 0xFFFF) ^ (0x8005 if (value >> 15) ^ bit else 0)
    return value


def test_checksums_of_layers_one_and_two():
    rng = random.Random(2)
    for word, covered in ((b"\xff\xfe\x94\x04", lambda body: 256), (b"\xff\xfe\x94\xc4", lambda body: 128), (b"\xff\xfe\x94\x54", lambda body: 4 * (8 * 2 + 24))):
        head = mpeg_audio.decode_header(word)
        frames = b""
        for _ in range(3):
            body = bytes(rng.randrange(256) for _ in range(head.length - 6))
            bits = [b >> k & 1 for b in word[2:4] + body for k in range(7, -1, -1)][: 16 + covered(body)]
            frames += word + struct.pack(">H", bit_crc(bits)) + body
        stream = mpeg_audio.read_stream(frames)
        assert (stream.checked, stream.bad_checksums) == (3, 0)
        broken = bytearray(frames)
        broken[8] ^= 0x10
        assert mpeg_audio.read_stream(bytes(broken)).bad_checksums == 1
    # Layer II, one channel, 48 kHz, 64 kbit/s: 11 fields of 4 bits, 12 of 3, 4 of 2; two bits for each that isn't zero
    word = b"\xff\xfc\x44\xc4"
    head = mpeg_audio.decode_header(word)
    assert (head.layer, head.channels, head.kbps) == (2, 1, 64)
    fields = [4] * 11 + [3] * 12 + [2] * 4
    values = [rng.randrange(1 << w) for w in fields]
    body = int("".join(f"{v:0{w}b}" for v, w in zip(values, fields, strict=True)).ljust(8 * (head.length - 6), "1"), 2).to_bytes(head.length - 6, "big")
    covered = sum(fields) + 2 * sum(v > 0 for v in values)
    bits = [b >> k & 1 for b in word[2:4] + body for k in range(7, -1, -1)][: 16 + covered]
    stream = mpeg_audio.read_stream((word + struct.pack(">H", bit_crc(bits)) + body) * 2)
    assert (stream.checked, stream.bad_checksums) == (2, 0)


def template_of(text, names):
    """The tokens of a template with their values, by hand: one scan from left to right."""
    import regex

    number = r"\p{N}+(?:[.,:]\p{N}+)*"
    capital = r"\p{Lu}[\p{Ll}\p{M}]+"
    units, articles = (set(x.split("|")) for x in (decontaminate.UNITS, decontaminate.ARTICLES))
    exact = set(decontaminate.FUNCTION_WORDS.split("|"))
    out = []
    for m in regex.finditer(rf"(?P<n>{number}(?:[\s,;/\-]+{number})*)|(?P<p>%)|(?P<w>[\p{{L}}\p{{M}}]+)", text):
        word, last = m[0], out[-1] if out else None
        gap = text[last[3] : m.start()] if last else ""
        if m["n"]:
            kind = "0"
        elif last and last[0] == "0" and not gap.strip() and (m["p"] or word.lower() in units):
            kind = "1"
        elif m["p"]:
            continue
        else:
            named = names and regex.fullmatch(capital, word) and word not in exact
            beside = gap and not regex.sub(r"[\s\-]", "", gap)
            if named and last and last[0] == "2" and beside:
                out[-1] = ("2", "2", last[2] + gap.lower() + word.lower(), m.end())
                continue
            after_article = last and last[0] == "w" and last[2] in articles and len(gap) == 1 and gap.isspace()
            after_number = last and last[0] == "0" and not gap.strip()
            kind = "2" if named and not after_article and not after_number else "w"
        out.append((kind, word.lower() if kind == "w" else kind, word.lower(), m.end()))
    return [(t, v) for _, t, v, _ in out]


def test_templates_against_a_plain_scan(spark):
    words = ["Maria", "Peter", "the", "The", "der", "Hund", "buys", "12", "3,5", "kg", "km", "Äpfel", "and", "%", "trains", "LA", "of", "Stunden", "7", "-", ",", ".", "Un", "día", "Miles"]
    rng = random.Random(8)
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ", "]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for names in (True, False):
        got = df.select("text", decontaminate.template(F.col("text"), names).alias("t"), decontaminate.raw_tokens(F.col("text"), names).alias("r")).collect()
        for r in got:
            assert len(r["t"]) == len(r["r"]), r
            want = template_of(r["text"], names)
            assert list(r["t"]) == [t for t, _ in want], r["text"]


def test_items_of_a_few_words_and_rows_that_share_an_id(spark):
    bench = spark.createDataFrame([(1, "he buys 12 apples for 30 cents"), (2, "yes no"), (3, "Yes"), (4, "Maria and Peter buy 12 apples for 30 cents each and sell 7 apples in Rome to Anna"), (4, "another text of this item with the same number"), (5, None), (None, "x y z w")], "item_id long, text string")
    rows = [(1, "he buys 12 dogs for 3 kg"), (2, "yes no"), (3, "yes"), (4, "I say yes no to it"), (5, "he buys 5 apples for 9 cents"), (None, "he buys 5 apples for 9 cents"), (None, "unrelated"), (7, "Anna and Hugo buy 5 apples for 9 cents each and sell 3 apples in Oslo to Paula"), (7, "unrelated words stand here"), (8, "Then another text of this item with the same number."), (9, "1 2 3 " * 60000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, held_doc int, row int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(2, 2), (3, 3), (5, 1), (None, 1), (7, 4), (8, 4)}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["text"][:9] for r in left.collect()) == ["1 2 3 1 2", "I say yes", "he buys 1", "unrelated", "unrelated"]
