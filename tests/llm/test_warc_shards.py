"""Archives of tables in which missing and repeated ids hold most of the bytes."""

from collections import Counter

from pyspark.sql import functions as F

from agoraspark.llm import warc


def test_hot_ids_lie_in_several_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "shard_bytes", lambda total: 20_000)
    same, other = "equal payload " * 120, "another payload " * 80
    rows = [(None, "u", f"null {i} " * 200) for i in range(60)] + [(5, "v", f"five {i} " * 200) for i in range(60)]
    rows += [(9, "w", same)] * 70 + [(i, "x", same) for i in (1, 2, 8)] + [(None, "y", same)] * 30 + [(None, "z", other)] * 40 + [(10, "q", other), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    manifest, folder = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == len(rows) and all(r["digests_agree"] for r in got)
    digest = {t: r for t in (same, other) if (r := __import__("hashlib").sha1(t.encode()).hexdigest())}
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] in digest.values())
    assert kinds == {(9, "response", None): 70, (1, "revisit", 9): 1, (2, "revisit", 9): 1, (8, "revisit", 9): 1, (None, "revisit", 9): 30, (None, "revisit", 10): 40, (10, "response", None): 1}
    bodies = Counter(bytes(r["payload"]).decode() for r in got if r["record_type"] == "response")
    assert bodies == Counter((h or "") for i, _, h in rows if not (h == same and i != 9) and not (h == other and i != 10))
    shards = {}
    for r in got:
        shards.setdefault((r["page_id"], r["payload_digest"] == digest[same]), set()).add(r["file"])
    assert len(shards[None, False]) > 3 and len(shards[5, False]) > 3 and len(shards[9, True]) > 3
    ids = []
    for name in tmp_path.joinpath("w").glob("*.warc.gz"):
        with open(name, "rb") as source:
            ids += [warc.parse_record(x)[0]["warc-record-id"] for x in warc.read_members(source)]
    assert len(ids) == len(set(ids)) == len(rows) + manifest.count()
    assert manifest.select(F.sum("records")).first()[0] == len(rows)
