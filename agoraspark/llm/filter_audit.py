"""How filters interact: what each of them removes at every step of every order in which they can be applied.

Orders share prefixes, and what is left after some filters doesn't depend on their order. So the states of a trie of all orders
are sets of filters: audit() walks it depth first, each state a persisted DataFrame of survivors that is filtered from its
parent's, and a state that was reached before isn't made again. In each state one aggregation counts, part by part, what every
filter that is still to come removes; these are the edges. With five filters there are 31 states and 80 edges for 120 orders.
At most one state for each level is persisted at a time. Survivors are rows of an id and flags, and go to disk where memory
ends; a lost executor's are filtered again from the table of flags, which lies in the shared folder.

Whatever an order's row says comes from edges: redundant is what the filter removes first of all less what it removes here;
unique_fails is what it removes last of all; shapley weighs each edge by the number of orders through it.

failing() gives the five filters' flags for documents. A null text counts as empty, a null lang as the part of the empty string. The
repeat filter fails documents whose text a row of a smaller doc_id has; rows without doc_id neither fail it nor make others
fail, rows that share the smallest doc_id pass. Labels that repeat a doc_id count if any of them is 1. Texts are read whole however
long. Equal texts meet as digests that are counted before the shuffle; the join that follows is one that adaptive execution
splits where one text is in a large share of the rows. An empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agoraspark.llm.common import own_folder, stored

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10  # the last two are hundredths
BLANKS = r"[\x20\x09-\x0D]+"
EDGE_SCHEMA = "part string, letter string, seen long, removed long, good_lost long, toxic_lost long"


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, the flags A to E (true: the filter removes the row), good and toxic of docs (doc_id, text, lang).

    A: few words. B: many words repeat. C: many capitals. D: holds one of #$%&*|. E: a smaller doc_id has the same text.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", BLANKS), "").alias("words"))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    slim = rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (words < MIN_WORDS).alias("A"),
        (F.lit(100) * distinct < F.lit(MIN_DISTINCT) * words).alias("B"),
        (F.lit(100) * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > F.lit(MAX_CAPITALS) * F.char_length("text")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    slim = stored(slim, "flags")
    # stored, so that both sides of the join are dealt for it alone, as adaptive execution needs to split a hot digest
    equal = stored(slim.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most"), "equal-texts")
    marked = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = slim.join(equal.select("digest", "least"), "digest", "left").join(marked, "doc_id", "left")
    no = F.lit(False)
    repeats = F.coalesce(F.col("doc_id") > F.col("least"), no)
    return joined.select("doc_id", "part", *"ABCD", repeats.alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def _edges(survivors: DataFrame, letters: list[str]) -> DataFrame:
    """What each of letters removes from survivors, by part."""

    def counts(letter: str) -> Column:
        gone = F.col(letter)
        return F.struct(F.lit(letter).alias("letter"), F.count_if(gone).alias("removed"), F.count_if(gone & F.col("good")).alias("good_lost"), F.count_if(gone & F.col("toxic")).alias("toxic_lost"))

    by_part = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("seen"), F.array(*map(counts, letters)).alias("edges"))
    return by_part.select("part", "seen", F.explode("edges").alias("e")).select("part", "e.letter", "seen", "e.removed", "e.good_lost", "e.toxic_lost")


def walk(rows: DataFrame, letters: str) -> DataFrame:
    """The edges of all states: part, letter, seen, removed, good_lost, toxic_lost and state (bits of the filters before).

    rows: part, good, toxic and a flag for each letter. Parts of which a state has no row are left out there.
    """
    spark, n, reached = rows.sparkSession, len(letters), {0}
    folder = own_folder(spark, "edges")

    def visit(state: int, survivors: DataFrame) -> None:
        rest = [i for i in range(n) if not state >> i & 1]
        _edges(survivors, [letters[i] for i in rest]).write.parquet(f"{folder}/state={state}")
        for i in rest:
            then = state | 1 << i
            if then in reached or then == (1 << n) - 1:
                continue
            reached.add(then)
            left = survivors.filter(~F.col(letters[i])).persist()
            visit(then, left)
            left.unpersist()

    base = rows.persist()
    visit(0, base)
    base.unpersist()
    return spark.read.schema(f"{EDGE_SCHEMA}, state int").parquet(folder)


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step. rows: as for walk()."""
    spark, n = rows.sparkSession, len(letters)
    edges, everything = stored(walk(rows, letters), "all-edges"), (1 << n) - 1
    # 80 edges and 600 steps for five filters, whatever the rows
    known = [(s, letters[i], everything == s | 1 << i, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(everything) for i in range(n) if not s >> i & 1]
    steps = [("".join(p), k + 1, p[k], sum(1 << letters.index(x) for x in p[:k])) for p in permutations(letters) for k in range(n)]
    ways = F.broadcast(spark.createDataFrame(known, "state int, letter string, last boolean, ways long"))
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, letter string, state int"))
    every = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(x).alias("letter")) for s, x, _, _ in known])).alias("e")
    grid = edges.filter((F.col("state") == 0) & (F.col("letter") == letters[0])).select("part", every).select("part", "e.state", "e.letter")
    numbers = ["seen", "removed", "good_lost", "toxic_lost"]
    full = grid.join(edges, ["part", "state", "letter"], "left").select("part", "state", "letter", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    own = Window.partitionBy("part", "letter")
    full = full.join(ways, ["state", "letter"]).select(
        "*",
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).over(own).alias("fails"),
        F.sum(F.when(F.col("last"), F.col("removed"))).over(own).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("ways")).over(own).alias("shapley"),
    )
    return full.join(orders, ["state", "letter"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("seen") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )
