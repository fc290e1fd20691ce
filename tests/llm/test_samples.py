"""What reaches the driver to learn toxicity from is bounded, whatever the ids, and settings aren't chosen by held-out rows."""

import numpy as np
from pyspark.sql import functions as F

from agoraspark.llm import simhash, toxicity, toxicity_settings


def test_sample_of_an_id_with_very_many_rows(spark):
    many = spark.range(20000).select(F.lit(1).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("row"), F.col("id").cast("string")).alias("text"))
    repeats = spark.range(3000).select(F.lit(2).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    rest = spark.range(3, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = many.unionAll(repeats).unionAll(rest)
    labels = spark.range(1, 60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    found = toxicity.sampled_rows(docs, toxicity._marked(labels), 20)
    kinds = np.bincount([r["toxic"] for r in found])
    assert kinds[1] < 80 and 5 < kinds[0] < 60  # 40 in expectation; without the second draw 20,000
    assert len([r for r in found if r["doc_id"] == 2]) <= 1
    assert found == toxicity.sampled_rows(docs.repartition(7), toxicity._marked(labels), 20)


def test_settings_read_no_held_out_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    other = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity_settings.learnable(docs, labels), toxicity_settings.learnable(docs, other)
    assert [r.tolist() for r in a[0]] == [r.tolist() for r in b[0]] and (a[1] == b[1]).all() and (a[2] == b[2]).all() and 0 < a[2].sum() < len(a[2])


def _prints(rng, n):
    """Fingerprints of five words of which many share the first 32 bits: near to a base, far from it, and chains that leave it."""
    base = rng.integers(0, 2**64, 5, np.uint64)

    def flipped(x, k):
        bits = np.unpackbits(x.view(np.uint8), bitorder="little")
        bits[32 + rng.choice(288, k, replace=False)] ^= 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    out = [flipped(base, int(k)) for k in rng.integers(5, 45, n)]
    for _ in range(12):
        a = flipped(base, 60)
        out += [a, flipped(a, 60), flipped(flipped(a, 60), 60)]  # the last are near to the one before alone
    other = rng.integers(0, 2**64, (n, 5), np.uint64)
    other[:, 0] = (other[:, 0] & np.uint64(0xFFFFFFFF00000000)) | (base[0] & np.uint64(0xFFFFFFFF))
    return np.array([*out, *other])


def test_the_limit_of_a_group_decides_no_link(spark, monkeypatch):
    fps = _prints(np.random.default_rng(8), 150)
    near = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=2) <= 70
    rows = [(i, 0, int(fp[0] & np.uint64(0xFFFFFFFF)), fp.view(np.int64).tolist()) for i, fp in enumerate(fps)]
    df = spark.createDataFrame(rows, "id long, lane int, key long, fp array<long>")

    def parts(links):
        root = list(range(len(rows)))

        def up(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(up(a), up(b))] = min(up(a), up(b))
        return [up(i) for i in range(len(rows))]

    want = parts(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    assert len(set(want)) > 100 and np.bincount(want).max() > 150
    for limit in (30, 1 << 16):
        monkeypatch.setattr(simhash, "BLOCK_LIMIT", limit)
        links = [tuple(r) for r in simhash.near_links(df, 32, 3, 70).collect()]
        assert all(near[a, b] for a, b in links) and parts(links) == want
