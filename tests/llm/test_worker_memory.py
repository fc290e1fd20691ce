"""What Python workers hold from one stage to the next, and how many texts pass at once."""

import public_tokenizers as P

import corpus_pipeline
from agoraspark.llm import bpe, chunks, common, simhash, weak_quality

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_other_stages_drop_the_codec(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words", 1, True)], "doc_id long, text string, place long, chosen boolean")
    given = []
    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", lambda self, run, schema: given.append(run))
        for step in (simhash.fingerprints, chunks.chunks, weak_quality._votes_and_sample):
            step(docs)
    assert len(given) == 3
    for run in given:
        bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
        assert bpe.codec.cache_info().currsize == 1
        list(run(iter(())))
        assert bpe.codec.cache_info().currsize == 0


def test_batches_of_texts_are_bounded(spark):
    docs, before = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.conf.get(ROWS)
    try:
        spark.conf.unset(ROWS)
        corpus_pipeline.tokens(spark, docs, "")
        assert spark.conf.get(ROWS) == str(common.TEXTS_PER_BATCH)
        spark.conf.set(ROWS, 77)
        corpus_pipeline.tokens(spark, docs, "")
        assert spark.conf.get(ROWS) == "77"
    finally:
        spark.conf.set(ROWS, before)
