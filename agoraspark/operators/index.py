"""A positional inverted index as tables: written once, read by the buckets of the words that a search asks for.

Each task indexes its own documents, SEGMENT words at a time, so postings aren't shuffled. A row is a word of a segment and a field, with
its postings (document, frequency, length of the field, positions) as an array. Rows lie in folders by a hash of the word, those of a
segment sorted by word, so a search lists and reads the folders of its words, and within them the pages that hold them. Lengths of
fields are rows of the empty word in a bucket of their own, and so are the documents, without a field.

Beside them lie, by word and field, how many documents there are and, by block of BLOCK ids, the greatest share that a posting of the block
can have in a score (block maxima), and the vocabulary with the deletions by which misspelt words are found.

Null texts are no documents of the index; documents without words have a length of 0 and count in the means. Ids are whole numbers
and not null; rows that share an id and a field are taken as further postings of it, so ids should be unique.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.functions.text import words
from agoraspark.sources.files import file_marks, shared_path

BUCKETS, BLOCK = 32, 64
SEGMENT = 1 << 21  # words
POSTING = pa.struct([("id", pa.int64()), ("tf", pa.int32()), ("length", pa.int32()), ("positions", pa.list_(pa.int32()))])
SEGMENTS = "field string, word string, postings array<struct<id: long, tf: int, length: int, positions: array<int>>>"
MAXIMA = "bucket int, word string, field string, n long, total long, blocks array<struct<block: long, most: double>>"
K1, B = 1.2, 0.75
PREFIX = 7  # letters of a word of which some are deleted
_BUILT: dict[tuple, Index] = {}


@dataclass(frozen=True)
class Index:
    """Paths of an index's tables, and what it counts: documents, and the mean length of each field."""

    spark: SparkSession
    folder: str
    n: int
    means: dict[str, float]

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}")
        return _single(rows) if name == "postings" else rows

    def postings(self, asked: list[str]) -> DataFrame:
        """The postings of some words: the buckets are literals, so other folders aren't read."""
        return of_buckets(self.table("postings"), "word", asked)


def _single(rows: DataFrame) -> DataFrame:
    """A row for each posting."""
    one = rows.select("bucket", "field", "word", F.explode("postings").alias("p"))
    return one.select("p.id", "field", "word", "p.tf", "p.length", "p.positions", "bucket", F.expr(f"p.id div {BLOCK}").alias("block"))


def bucket(word: Column) -> Column:
    return (F.crc32(word.cast("binary")) % BUCKETS).cast("int")


def of_buckets(rows: DataFrame, key: str, asked: list[str]) -> DataFrame:
    """The rows whose key is one of asked, by the folders that can hold them."""
    return rows.filter(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in asked})) & F.col(key).isin(asked))


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Documents of so many words together, or one that has more; batches are put together or cut."""
    held, size = [], 0
    for batch in batches:
        words_of = sum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
        after, first = np.cumsum(words_of), 0
        while first < batch.num_rows:
            before = after[first] - words_of[first]
            fits = int(np.searchsorted(after, before + most - size, side="right"))
            if fits == first and not held:
                fits = first + 1
            if fits > first:
                held.append(batch.slice(first, fits - first))
                size += int(after[fits - 1] - before)
                first = fits
            if first < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _lists(offsets: np.ndarray, *columns: np.ndarray | pa.Array) -> pa.ListArray:
    """Arrays of postings from the begin of each and the end."""
    inner = pa.StructArray.from_arrays([pa.array(c, t.type) if isinstance(c, np.ndarray) else c for c, t in zip(columns, POSTING, strict=True)], fields=list(POSTING))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), inner)


def _segments(docs: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """A row for each word and field of a segment; rows of the empty word with each field's lengths, and one with the documents.

    Fields are texts, or arrays of words.
    """
    segment = SEGMENT

    def rows(field: str, word: pa.Array, postings: pa.ListArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([field] * len(word), pa.string()), word, postings], ["field", "word", "postings"])

    def alone(field: str, ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        zeros = np.zeros(len(ids) + 1, np.int32)
        return rows(field, pa.array([""]), _lists(np.array([0, len(ids)]), ids, zeros[1:], lengths.astype(np.int32), pa.ListArray.from_arrays(pa.array(zeros), pa.array([], pa.int32()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, segment):
            ids = piece.column(0).to_numpy()
            by_id = np.argsort(ids, kind="stable")
            piece, ids, some = piece.take(pa.array(by_id)), ids[by_id], np.zeros(len(ids), bool)
            for field, column in zip(fields, piece.columns[1:], strict=True):
                listed = column.combine_chunks()
                there = listed.is_valid().to_numpy(zero_copy_only=False)
                some |= there
                lengths = np.where(there, listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
                yield alone(field, ids[there], lengths[there])
                coded = listed.flatten().dictionary_encode()
                if not len(coded):
                    continue
                by_word = pc.sort_indices(coded.dictionary)
                rank = np.empty(len(by_word), np.int64)
                rank[by_word.to_numpy()] = np.arange(len(by_word))
                owner = np.repeat(np.arange(len(ids)), lengths)
                place = (np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
                key = rank[coded.indices.to_numpy(zero_copy_only=False)] * len(ids) + owner
                del owner
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                ends = np.append(first, len(order))
                code, doc = np.divmod(key[first], len(ids))
                positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order]))
                begun = np.flatnonzero(np.diff(code, prepend=-1))  # a row a word
                postings = _lists(np.append(begun, len(code)), ids[doc], np.diff(ends).astype(np.int32), lengths[doc].astype(np.int32), positions)
                yield rows(field, coded.dictionary.take(by_word), postings)
            yield alone("", ids[some], np.zeros(int(some.sum())))

    listed = [F.col(f) if docs.schema[f].dataType.typeName() == "array" else words(F.col(f)) for f in fields]
    return docs.select(F.col(id_).cast("long"), *listed).filter(F.col(id_).isNotNull()).mapInArrow(run, SEGMENTS)


def _maxima(rows: DataFrame, means: dict[str, float], size: int) -> DataFrame:
    """Documents, frequency and block maxima of each row of the index; a block that several rows hold has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            listed = batch.column(3)
            lengths = listed.value_lengths().to_numpy(zero_copy_only=False)
            ids, tf, length = (x.to_numpy(zero_copy_only=False) for x in listed.flatten().flatten())
            mean = np.repeat(np.array([means.get(f) or 1.0 for f in batch.column(2).to_pylist()]), lengths)
            share = tf / (1 - B + B * length / mean)
            owner, block = np.repeat(np.arange(len(lengths)), lengths), np.sign(ids) * (np.abs(ids) // size)
            order = np.lexsort((block, owner))  # ids of a row ascend, but for negative ones this sorts nothing
            owner, block, share = owner[order], block[order], share[order]
            first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(block, prepend=0) != 0))
            inner = pa.StructArray.from_arrays([pa.array(block[first]), pa.array(np.maximum.reduceat(share, first))], ["block", "most"])
            offsets = np.searchsorted(owner[first], np.arange(len(lengths) + 1)).astype(np.int32)
            total = np.add.reduceat(tf.astype(np.int64), np.cumsum(lengths) - lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths.astype(np.int64)), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), inner)], ["bucket", "word", "field", "n", "total", "blocks"])

    short = F.transform("postings", lambda p: F.struct(p["id"].alias("id"), p["tf"].alias("tf"), p["length"].alias("length"))).alias("postings")
    return rows.select("bucket", "word", "field", short).mapInArrow(run, MAXIMA)


def _write(rows: DataFrame, path: str) -> None:
    """Rows in folders by bucket; a task has a file of each bucket open, so that rows needn't be sorted by it, which would spill."""
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(BUCKETS + 2))  # a bucket more for lengths, and one to stay below the limit
    try:
        rows.write.partitionBy("bucket").option("parquet.page.row.count.limit", "200").parquet(path)
    finally:
        conf.set(name, before)


def build(docs: DataFrame, id_: str, fields: list[str]) -> Index:
    """Write the index of docs."""
    spark, folder = docs.sparkSession, shared_path(docs.sparkSession, "index")
    place = F.when(F.col("word") == "", -1).otherwise(bucket(F.col("word")))
    _write(_segments(docs, id_, fields).withColumn("bucket", place), f"{folder}/postings")
    stored = spark.read.schema(f"{SEGMENTS}, bucket int").parquet(f"{folder}/postings")
    counted = stored.filter("bucket = -1").select("field", F.explode("postings.length").alias("length")).groupBy("field")
    known = {r["field"]: r for r in counted.agg(F.avg("length").alias("mean"), F.count(F.lit(1)).alias("n")).collect()}  # a row a field
    means = {f: known[f]["mean"] if f in known else 0.0 for f in fields}
    index = Index(spark, folder, known[""]["n"] if "" in known else 0, means)
    _write(_maxima(stored.filter("bucket >= 0"), means, BLOCK), f"{folder}/maxima")
    vocabulary = spark.read.schema(MAXIMA).parquet(f"{folder}/maxima").groupBy("bucket", "word", "field").agg(F.sum("n").alias("docs"), F.sum("total").alias("total"))
    vocabulary.write.parquet(f"{folder}/vocabulary")
    return index


def kept(docs: DataFrame, id_: str, fields: list[str], label: str) -> Index:
    """The index of docs, built at its first use in this application. label: what docs is derived from its files by."""
    key = (docs.sparkSession.sparkContext.applicationId, label, id_, tuple(fields), file_marks(docs))
    if key not in _BUILT:
        _BUILT[key] = build(docs, id_, fields)
    return _BUILT[key]


def _norm(index: Index) -> Column:
    """What a posting's frequency is divided by: its field's length against the mean."""
    mean = F.lit(1.0)
    for field, value in index.means.items():
        mean = F.when(F.col("field") == field, F.lit(float(value) or 1.0)).otherwise(mean)
    return F.lit(1 - B) + F.lit(B) * F.col("length") / mean


def _weight(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for field, w in weights.items():
        out = F.when(F.col("field") == field, F.lit(float(w))).otherwise(out)
    return out


def _idf(index: Index, asked: list[str], weights: dict[str, float]) -> dict[str, float]:
    """How rare each word is, by the documents that hold it in one of the fields."""
    if len(weights) == 1:
        found = index.table("vocabulary").filter(F.col("word").isin(asked) & F.col("field").isin(list(weights))).select("word", F.col("docs").alias("df")).collect()
    else:
        found = index.postings(asked).filter(F.col("field").isin(list(weights))).groupBy("word").agg(F.count_distinct("id").alias("df")).collect()
    return {r["word"]: float(np.log(1 + (index.n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in found}  # a row a word


def _scored(rows: DataFrame, index: Index, idf: dict[str, float], weights: dict[str, float]) -> DataFrame:
    """id, matched and score of postings."""
    rare = F.lit(0.0)
    for word, value in idf.items():
        rare = F.when(F.col("word") == word, F.lit(value)).otherwise(rare)
    x = rows.groupBy("id", "block", "word").agg(F.sum(_weight(weights) * F.col("tf") / _norm(index)).alias("x"))
    return x.groupBy("id", "block").agg(F.count(F.lit(1)).alias("matched"), F.sum(rare * F.col("x") * (K1 + 1) / (F.col("x") + K1)).alias("score"))


def scores(index: Index, asked: list[str], weights: dict[str, float]) -> DataFrame:
    """id, matched (how many of the words) and score of every document that holds one of the words."""
    rows = index.postings(asked).filter(F.col("field").isin(list(weights)))
    return _scored(rows, index, _idf(index, asked, weights), weights).select("id", "matched", "score")


def top(index: Index, asked: list[str], weights: dict[str, float], k: int) -> tuple[DataFrame, dict[str, int]]:
    """The k best of scores() (equal ones by ascending id), and how many blocks there were and were scored.

    The maxima bound the score in every block. The blocks with the greatest bounds are scored first; their k-th score is one that
    the whole has as well, so blocks whose bound is below it are skipped. What is skipped can't be among the k best.
    """
    idf = _idf(index, asked, weights)
    rare = F.lit(0.0)
    for word, value in idf.items():
        rare = F.when(F.col("word") == word, F.lit(value)).otherwise(rare)
    maxima = of_buckets(index.table("maxima"), "word", asked).filter(F.col("field").isin(list(weights)))
    most = maxima.select("word", "field", F.inline("blocks")).groupBy("block", "word", "field").agg(F.max("most").alias("most"))
    x = most.groupBy("block", "word").agg(F.sum(_weight(weights) * F.col("most")).alias("x"))
    bounds = x.groupBy("block").agg(F.sum(rare * F.col("x") * (K1 + 1) / (F.col("x") + K1)).alias("bound")).persist()
    rows = index.postings(asked).filter(F.col("field").isin(list(weights)))
    order = [F.desc("score"), F.col("id")]
    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(max(4, k // 4)).collect()]  # a fixed number of blocks
    sure = _scored(rows.filter(F.col("block").isin(first)), index, idf, weights).orderBy(*order).limit(k).collect()
    least = sure[-1]["score"] if len(sure) == k else 0.0
    left = bounds.filter(F.col("bound") >= least * (1 - 1e-9)).select("block")
    counts = {"blocks": bounds.count(), "scored": left.count()}
    best = _scored(rows.join(left, "block", "left_semi"), index, idf, weights).orderBy(*order).limit(k)
    return best.select("id", "matched", "score"), counts


def total_up_to(index: Index, asked: list[str], cap: int) -> tuple[int, bool]:
    """How many documents hold one of the words, counted to cap at most, and whether there are more."""
    n = index.postings(asked).select("id").distinct().limit(cap + 1).count()
    return min(n, cap), n > cap


def phrase(index: Index, asked: list[str], field: str) -> DataFrame:
    """id and starts (positions) of the documents whose field has the words side by side."""
    out = None
    rows = index.postings(sorted(set(asked))).filter(F.col("field") == field)
    for i, word in enumerate(asked):
        before = F.lit(i)
        here = rows.filter(F.col("word") == word).select("id", F.transform("positions", lambda p: p - before).alias(f"at{i}"))  # noqa: B023
        out = here if out is None else out.join(here, "id").withColumn("at0", F.array_intersect("at0", f"at{i}")).drop(f"at{i}").filter(F.size("at0") > 0)
    return out.select("id", F.col("at0").alias("starts"))


# misspelt words


def deletions(word: Column, edits: int) -> Column:
    """What is left of a word's first letters when up to so many are deleted."""
    start = F.array(F.substring(word, 1, PREFIX))
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(PREFIX))))
    out, last = start, start
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, drop)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def allowed(word: Column) -> Column:
    """Edits that a word of its length may have: none below 4 characters, 1 below 8, else 2; none for numbers."""
    return F.when((F.length(word) < 4) | word.rlike(r"^\p{N}+$"), 0).when(F.length(word) < 8, 1).otherwise(2)


def near_words(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, word and edits: the words of vocabulary (word) within the edits that each of asked (asked) may have.

    Two words within some edits share what is left of their first letters after as many deletions, so pairs come from a join by
    that; they are then measured. No word is compared with all others.
    """
    wanted = asked.select("asked", allowed(F.col("asked")).alias("most")).distinct()
    keys = F.when(F.col("most") == 0, F.array("asked")).when(F.col("most") == 1, deletions(F.col("asked"), 1)).otherwise(deletions(F.col("asked"), 2))
    # only words of lengths that can be met take part, with as many deletions as are asked for; lengths are few
    lengths = wanted.filter("most > 0").select(F.length("asked").alias("n"), "most").distinct().collect()
    met = sorted({r["n"] + d for r in lengths for d in range(-r["most"], r["most"] + 1)})
    near = deletions(F.col("word"), max([r["most"] for r in lengths], default=0))
    theirs = vocabulary.filter(F.length("word").isin(met)).select("word", F.explode(near).alias("key"))
    fuzzy = wanted.filter("most > 0").select("asked", "most", F.explode(keys).alias("key"))
    pairs = fuzzy.join(theirs, "key").filter(F.abs(F.length("asked") - F.length("word")) <= F.col("most")).select("asked", "most", "word").distinct()
    exact = wanted.filter("most = 0").join(vocabulary.select("word").distinct(), F.col("asked") == F.col("word")).select("asked", "most", "word")
    return pairs.unionByName(exact).withColumn("edits", F.levenshtein("asked", "word")).filter("edits <= most").select("asked", "word", "edits")


def ranked(index: Index, asked: list[str], fields: list[str], k: int, sort: DataFrame | None = None, score: DataFrame | None = None) -> DataFrame:
    """The k best documents by seven rules in turn, each an ascending number: words, typo, proximity, attribute, sort, exactness, score.

    words: asked words without a match, within their edits. typo: edits of the best matches. proximity: the least distances between the
    matches of neighbouring asked words, 8 at most each, summed. attribute: the first of fields that holds a match. sort and score: tables of
    id and value, by which documents come ascending and descending. exactness: asked words that aren't matched as they stand.
    """
    terms = index.spark.createDataFrame([(w,) for w in dict.fromkeys(asked)], "asked string")
    near = near_words(index.table("vocabulary").select("word"), terms).collect()  # a few words for each that is asked
    edits = {(r["asked"], r["word"]): r["edits"] for r in near}
    rows = index.postings(sorted({w for _, w in edits})).filter(F.col("field").isin(fields))
    options = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(w).alias("w"), F.lit(edits[a, w]).alias("edits")) for j, a in enumerate(asked) for w in [x for y, x in edits if y == a]))).alias("o")
    place = F.lit(0)
    for i, field in enumerate(fields):
        place = F.when(F.col("field") == field, i).otherwise(place)
    met = rows.select("id", "word", place.alias("nth"), "positions", options).filter("word = o.w")
    every = F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(F.col("nth").alias("field"), p.alias("at")))))
    by_term = met.groupBy("id", "o.j").agg(F.min("o.edits").alias("edits"), F.min("nth").alias("field"), every.alias("at"))
    by_doc = by_term.groupBy("id").agg(F.sum("edits").alias("typo"), F.min("field").alias("attribute"), F.count_if(F.col("edits") == 0).alias("exact"), F.count(F.lit(1)).alias("n"), F.map_from_entries(F.collect_list(F.struct("j", "at"))).alias("at"))

    def gap(j: int) -> Column:
        a, b = F.col("at")[F.lit(j)], F.col("at")[F.lit(j + 1)]
        merged = F.array_sort(F.concat(F.transform(a, lambda x: F.struct(x["field"].alias("field"), x["at"].alias("at"), F.lit(0).alias("t"))), F.transform(b, lambda x: F.struct(x["field"].alias("field"), x["at"].alias("at"), F.lit(1).alias("t")))))
        gaps = F.zip_with(merged, F.slice(merged, F.lit(2), F.size(merged)), lambda x, y: F.when((x["t"] != y["t"]) & (x["field"] == y["field"]), y["at"] - x["at"]))
        return F.least(F.coalesce(F.array_min(gaps), F.lit(8)), F.lit(8))

    proximity = sum((gap(j) for j in range(len(asked) - 1)), F.lit(0))
    out = by_doc.select("id", (F.lit(len(asked)) - F.col("n")).alias("words"), "typo", proximity.alias("proximity"), "attribute", (F.lit(len(asked)) - F.col("exact")).alias("exactness"))
    for name, given in (("sort", sort), ("score", score)):
        out = out.join(given.select("id", F.col("value").alias(name)), "id", "left") if given is not None else out.withColumn(name, F.lit(0))
    order = ["words", "typo", "proximity", "attribute", F.asc_nulls_last("sort"), "exactness", F.desc_nulls_last("score"), "id"]
    best = out.orderBy(*order).limit(k)  # what the window numbers are k rows
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))
