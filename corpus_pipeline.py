"""A corpus pipeline over documents: five stages, each written as Parquet and read again as the next one's input.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of docs. What they do with odd
rows follows from the operators: a null text counts as empty, and as quality rejects texts without words, only a stage that
is called by itself meets it (near_duplicates takes empty texts as equal, repeated_passages and benchmark_leaks let them
pass, tokens gives them no ids). Rows without doc_id are decided by their text, near_duplicates lets them pass. Rows that
share a doc_id are decided apart unless their texts are equal; repeated rows stay or go together. Texts are read whole however
long. Of equally good documents of a group that of the least doc_id stays. Empty tables give empty results. Further columns
stay as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from agoraspark.llm import bpe, chunks, decontaminate, simhash, weak_quality
from agoraspark.llm.common import bound_batches, ship_package, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go."""
    ship_package(spark)
    bound_batches(spark)
    return weak_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id."""
    ship_package(spark)
    bound_batches(spark)
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the later ones."""
    ship_package(spark)
    bound_batches(spark)
    return chunks.remove_runs(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of ids and of decoded bytes."""
    ship_package(spark)
    bound_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Trained scorers, fingerprints and token ids are beyond SQL. Of the stages, tests hold near_duplicates against exact
#: similarities, repeated_passages against a dictionary of chunks, benchmark_leaks' templates against a plain scan, tokens
#: against the library, quality against its scores, and run() against its stages in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
