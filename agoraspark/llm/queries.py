"""The operators of this folder, each over its whole table, in the columns that the contracts name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.llm import bpe, chat, chunks, decontaminate, filter_audit, langid, lexical, mpeg_audio, simhash, token_store, toxicity, warc, weak_quality
from agoraspark.llm.common import table

WORDS_FILE, END_ID = "word_bpe_49k.json", 2
RANKS_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the ranks of a public multilingual vocabulary."""
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to WARC archives and read them back."""
    manifest, folder = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that aren't held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that holds the template's marks, and digest what is read back."""
    marks = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.read_back(chat.formatted(chat.canonical_turns(chat.as_records(rows))).select("conv_id", "formatted", "mask"))
    listed = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as MPEG audio frames, read them back, and digest what was read."""
    return mpeg_audio.media_features(mpeg_audio.encode_media(table(spark, sf_dir, "documents")))


def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a scorer trained on weak labels."""
    return weak_quality.quality_scores(table(spark, sf_dir, "documents"))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that repeat passages of earlier ones, with the spans to cut."""
    return chunks.repeated_runs(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token ids of all documents to binary shards with an index of their keys, and read all of them by key."""
    docs = table(spark, sf_dir, "documents")
    store = token_store.write_store(docs, public_tokenizers.path(WORDS_FILE), END_ID)
    return token_store.read_store(store, docs, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at every step of all their orders, by language."""
    return filter_audit.audit(filter_audit.failing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_language": op1_language,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_templates": op3_templates,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_chat": op6_chat,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_weak_labels": op8_weak_labels,
    "op9_chunk_dedup": op9_chunk_dedup,
    "op10_simhash": op10_simhash,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_store": op12_token_store,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN is_revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN is_revisit THEN keep END AS refers_to
FROM (SELECT *, octet_length(encode(payload)) >= 1000 AND keep IS NOT NULL AND page_id IS DISTINCT FROM keep AS is_revisit
      FROM (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages))""",
    "op6_chat": r"""
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(text, '(\\*)(\[/?INST\]|</?s>|<</?SYS>>|<<ROLE:|<</ROLE>>)', '\1\1\\\2', 'g')) + 2
                + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 18 + length(url_encode(role)) END) + count(*) - 1 AS BIGINT) AS formatted_chars
FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
GROUP BY conv_id""",
    "op11_lexical_search": r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
     asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     corpus AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_terms FROM words),
     lengths AS (SELECT doc_id, 100 - 25 + (25 * count(*)::HUGEINT * any_value(n_docs)) // any_value(n_terms) AS m FROM words, corpus GROUP BY doc_id),
     weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(DISTINCT doc_id) + 1)::DOUBLE))::HUGEINT AS w
                 FROM words, corpus GROUP BY term),
     postings AS (SELECT term, doc_id, count(*)::HUGEINT AS tf FROM words GROUP BY term, doc_id),
     scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
                FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op13_filter_audit": r"""
WITH split AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                      list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
     flagged AS (SELECT part, CAST(len(words) < 100 AS INT) + 2 * CAST(100 * list_unique(words) < 80 * len(words) AS INT)
                        + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
                        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
                        + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask,
                        coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
                        coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS bad FROM split),
     profiles AS (SELECT part, mask, good, bad, count(*) AS n FROM flagged GROUP BY ALL),
     letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, bit)),
     orders AS (SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letter a, letter b, letter d, letter e, letter f
                WHERE a.bit + b.bit + d.bit + e.bit + f.bit = 31 AND a.bit | b.bit | d.bit | e.bit | f.bit = 31),
     steps AS (SELECT filter_order, step::INTEGER AS step, c, bit, coalesce((SELECT sum(p.bit)::INTEGER FROM letter p WHERE instr(filter_order, p.c) < step), 0) AS before
               FROM orders, range(1, 6) AS r(step), letter WHERE c = substr(filter_order, step, 1)),
     counted AS (SELECT part, filter_order, step, c,
                        coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
                        coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
                        coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
                        coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
                        coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0 AND good), 0)::BIGINT AS good_lost,
                        coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0 AND bad), 0)::BIGINT AS toxic_lost
                 FROM profiles, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM counted""",
}
