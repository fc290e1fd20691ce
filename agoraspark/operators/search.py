"""Keyword search over documents: scored terms, phrases, exclusions, and a filter of fields."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoraspark.functions.text import words


def bm25(docs: DataFrame, id_: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, matched (how many of the terms) and score of every document that holds a term.

    Only the occurrences of the asked terms are counted, per document and without a shuffle; the document frequencies
    and the mean length are sums over all documents that combine before the shuffle, and come back as one row.
    """
    low, edge = F.lower(text), r"[\p{L}\p{N}]"
    counts = [F.regexp_count(low, F.lit(rf"{re.escape(t)}(?<!{edge}{re.escape(t)})(?!{edge})")) for t in terms]  # the letters first, then their edges
    rows = docs.select(F.col(id_), F.regexp_count(text, F.lit(f"{edge}+")).alias("length"), F.array(*counts).alias("tf"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))))
    met = rows.filter(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(totals))  # one row

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col("tf")[i]
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))

    score = reduce(lambda x, y: x + y, (part(i) for i in range(len(terms))))
    return met.select(id_, F.size(F.filter("tf", lambda x: x > 0)).alias("matched"), score.alias("score"))


def within_edits(rows: DataFrame, column: str, asked: str) -> DataFrame:
    """Rows whose word is within the edits that its length allows: none below 4 characters, 1 below 8, else 2; none for numbers."""
    allowed = 0 if len(asked) < 4 or asked.isdigit() else 1 if len(asked) < 8 else 2
    distance = F.levenshtein(F.col(column), F.lit(asked))
    return rows.withColumn("edits", distance).filter(F.col("edits") <= allowed)


def phrase(text: Column, wanted: str) -> Column:
    """Whether the words of a phrase stand side by side in a text."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" ")).contains(f" {wanted.lower()} ")


def filters(spec: dict) -> Column:
    """A condition from a declarative filter: {"column": value or list of values, ("column", op): value, "not": {...}}.

    Values of one column are alternatives, columns are all required; None asks for null. An empty filter holds for all.
    """
    ops = {
        ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
        "..": lambda c, v: c.between(*v), "prefix": lambda c, v: c.startswith(v)
    }
    out = F.lit(True)
    for key, value in spec.items():
        if key == "not":
            out = out & ~F.coalesce(filters(value), F.lit(False))
        elif isinstance(key, tuple):
            out = out & ops[key[1]](F.col(key[0]), value)
        elif value is None:
            out = out & F.col(key).isNull()
        else:
            out = out & F.col(key).isin(value if isinstance(value, list) else [value])
    return out


def distinct_best(rows: DataFrame, group: str, order: list) -> DataFrame:
    """The best row of each group by a total order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_place = 1").drop("_place")


def postings(docs: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """id, field, word, tf, length: how often each word stands in each field of a document, and how long the field is.

    Words are counted within the row, so what is shuffled later is one row a document and word. Written partitioned by a
    hash of the word, this is the index that searches read a few words of.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.array_sort(words(F.col(f))).alias("w")) for f in fields)))
    rows = docs.select(F.col(id_).alias("id"), each.alias("p")).select("id", "p.field", "p.w").filter(F.size("w") > 0)
    # runs of equal words in the sorted list, by where they begin
    rows = rows.withColumn("b", F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (x != F.get("w", i - 1)), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("e", F.concat(F.slice("b", F.lit(2), F.size("b") - 1), F.array(F.size("w"))))
    runs = F.zip_with("b", "e", lambda b, e: F.struct(F.get("w", b).alias("word"), (e - b).cast("long").alias("tf")))
    return rows.select("id", "field", F.size("w").alias("length"), F.explode(runs).alias("c")).select("id", "field", "c.word", "c.tf", "length")


def postings_score(index: DataFrame, terms: list[str], weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, matched (how many of the terms) and score of documents by an index of postings; fields count by their weights.

    Frequencies of a term are put together over fields, each against the mean length of its field, before they saturate.
    Documents without a word aren't in the index and don't count.
    """
    weight = F.lit(0.0)
    for field, w in weights.items():
        weight = F.when(F.col("field") == field, F.lit(w)).otherwise(weight)
    lengths = index.groupBy("id", "field").agg(F.first("length").alias("length"))
    means = lengths.groupBy("field").agg(F.avg("length").alias("mean"))  # one row a field
    total = lengths.agg(F.count_distinct("id").alias("n"))
    met = index.filter(F.col("word").isin(terms)).join(F.broadcast(means), "field")
    by_term = met.groupBy("id", "word").agg(F.sum(weight * F.col("tf") / (1 - b + b * F.col("length") / F.col("mean"))).alias("x"))
    known = by_term.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # a row a term
    rows = by_term.join(F.broadcast(known), "word").crossJoin(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return rows.groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("matched"), F.sum(idf * F.col("x") * (k1 + 1) / (F.col("x") + k1)).alias("score")
    )


def variants(terms: list[str], quoted: str | None, kept: dict) -> list[tuple[str, str, list[str], str | None, dict]]:
    """Looser forms of a search: reason, how it reads, words, phrase, filters. Without filters, with a loose phrase, without each word."""
    reads = lambda w, q: " ".join([*w, *([f'"{q}"'] if q else [])])
    out = []
    if kept:
        out.append(("filters", reads(terms, quoted), terms, quoted, {}))
    if quoted:
        out.append(("phrase", " ".join([*terms, quoted]), [*terms, *quoted.split()], None, kept))
    for i in range(len(terms) if len(terms) > 1 else 0):
        rest = terms[:i] + terms[i + 1 :]
        out.append(("term", reads(rest, quoted), rest, quoted, kept))
    return out
