"""Filters, keyword search, suggestions, and reports on text: scores, language, markup, census."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.functions import text as T
from agoraspark.operators import index as ix
from agoraspark.operators.search import distinct_best, filters
from agoraspark.plans.base import EVENTS, Theme, events, table
from agoraspark.sources.files import materialised

theme = Theme()
TERMS = ["the", "reading", "thing"]
WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@theme.add("""
SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND NOT (o_custkey IN (1, 2, 3))""")
def flt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declarative filter: alternatives within a field, all fields required, ranges, a negated part."""
    spec = {
        "o_orderstatus": ["F", "P"], "o_orderpriority": "1-URGENT", ("o_totalprice", ".."): (1000, 200000),
        ("o_orderdate", ">="): F.lit("1996-01-01").cast("timestamp_ntz"), "not": {"o_custkey": [1, 2, 3]}
    }
    return table(spark, sf_dir, "orders").filter(filters(spec)).select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))


@theme.add(f"SELECT event_id, item FROM {EVENTS} WHERE (item NOT IN (3, 4) AND user_id <> 7) AND (event_type <> 'error' OR user_id < 10)")
def flt_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level visibility: denied items never, errors only for some users."""
    visible = ~F.col("item").isin(3, 4) & (F.col("user_id") != 7) & ((F.col("event_type") != "error") | (F.col("user_id") < 10))
    return events(spark, sf_dir).filter(visible).select("event_id", "item")


@theme.add("SELECT event_id, CAST(substr(tag, 7) AS BIGINT) AS item FROM (SELECT event_id, 'order:' || json_extract_string(props, '$.k') AS tag, value FROM events) WHERE tag LIKE 'order:%' AND value >= 85")
def flt_prefix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference by prefix, and the number behind it."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("order:"), F.get_json_object("props", "$.k")).alias("tag"), "value")
    return rows.filter(F.col("tag").startswith("order:") & (F.col("value") >= 85)).select(
        "event_id", F.expr("try_cast(substring(tag, 7) as bigint)").alias("item")
    )


@theme.add("SELECT o_orderkey AS orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01' UNION SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 21 DAY")
def flt_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month with an inclusive end, or a look back of three weeks."""
    at, ts = F.col("o_orderdate"), lambda x: F.lit(x).cast("timestamp_ntz")
    month = (at >= ts("1997-03-01")) & (at < ts("1997-04-01"))
    return table(spark, sf_dir, "orders").filter(month | (at > ts("2001-08-01") - F.expr("interval 21 days"))).select(F.col("o_orderkey").alias("orderkey"))


@theme.add("SELECT page_id FROM pages WHERE length(html) BETWEEN 500 AND 20000 AND NOT regexp_matches(html, '(?i)lorem|casino')")
def flt_length_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on length and a pattern that isn't wanted."""
    return table(spark, sf_dir, "pages").filter(F.char_length("html").between(500, 20000) & ~F.col("html").rlike("(?i)lorem|casino")).select("page_id")


@theme.add(f"SELECT id, CAST(pos AS INTEGER) AS pos, n FROM (VALUES (7, 0), (3, 1), (50, 2), (12345678, 3)) AS w(id, pos) LEFT JOIN (SELECT item, count(*) AS n FROM {EVENTS} GROUP BY 1) ON item = id")
def prj_rehydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ids with what is known of each, in the given order."""
    wanted = spark.range(1).select(F.posexplode(F.array(*(F.lit(i) for i in (7, 3, 50, 12345678)))).alias("pos", "id"))
    known = events(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(known, F.col("item") == F.col("id"), "left").select("id", "pos", "n")


@theme.add("SELECT event_id, coalesce('u' || nullif(user_id, 7), 's' || (event_id % 100)) AS viewer, CASE event_type WHEN 'purchase' THEN 5.0 WHEN 'click' THEN 2.0 WHEN 'view' THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM events")
def prj_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A viewer's identity by user or else session, and a weight from a map."""
    weights = F.create_map(*(F.lit(x) for pair in {"purchase": 5.0, "click": 2.0, "view": 1.0}.items() for x in pair))
    user = F.concat(F.lit("u"), F.nullif("user_id", F.lit(7).cast("long")).cast("string"))
    session = F.concat(F.lit("s"), (F.col("event_id") % 100).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(user, session).alias("viewer"),
        F.coalesce(weights[F.col("event_type")], F.lit(0.0)).alias("weight")
    )


def distance_sql(a: str, b: str) -> str:
    """Edits between two lower-case words as the other dialect counts them if every letter is one byte."""
    one = lambda x: f"translate({x}, 'àâäáãåçèéêëìíîïñòóôöõùúûüýÿßœæ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%')"
    return f"levenshtein({one(a)}, {one(b)})"


def document_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The index of documents by their first twelve words (title) and all words (body), built once an application."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.words(F.col("text")).alias("body"))
    return ix.kept(rows.select("doc_id", F.slice("body", 1, 12).alias("title"), "body"), "doc_id", ["title", "body"], "title and body")


@theme.add(f"SELECT word, count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({WORDS}) AS word FROM documents) GROUP BY 1, 2) GROUP BY 1")
def ql_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the index of documents, which is built here if no search has done it before."""
    return document_index(spark, sf_dir).table("vocabulary").filter("field = 'body'").select("word", "docs", "total")


@theme.add(f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, len(w) AS length, [{', '.join(f"len(list_filter(w, lambda x: x = '{t}'))" for t in TERMS)}] AS tf FROM d),
t AS (SELECT count(*) AS n, avg(length) AS mean, [{', '.join(f'count_if(tf[{i + 1}] > 0)' for i in range(3))}] AS df FROM c)
SELECT doc_id, CAST(len(list_filter(tf, lambda x: x > 0)) AS INTEGER) AS matched, round({' + '.join(f'ln(1 + (n - df[{i + 1}] + 0.5) / (df[{i + 1}] + 0.5)) * tf[{i + 1}] * 2.2 / (tf[{i + 1}] + 1.2 * (0.25 + 0.75 * length / mean))' for i in range(3))}, 6) AS score
FROM c, t WHERE len(list_filter(tf, lambda x: x > 0)) > 0""")
def ql_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of three terms over all documents, from the postings of these terms."""
    found = ix.scores(document_index(spark, sf_dir), TERMS, {"body": 1.0})
    return found.select(F.col("id").alias("doc_id"), F.col("matched").cast("int").alias("matched"), F.round("score", 6).alias("score"))


@theme.add(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({WORDS}, ' ') || ' ' AS t FROM documents) WHERE contains(t, ' of the ') AND NOT contains(t, ' idiot ')")
def ql_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase and without a word, by positions."""
    index = document_index(spark, sf_dir)
    without = index.postings(["idiot"]).filter("field = 'body'").select("id")
    return ix.phrase(index, ["of", "the"], "body").join(without, "id", "left_anti").select(F.col("id").alias("doc_id"))


@theme.add(f"SELECT word, count(*) AS n, CAST({distance_sql('word', "'herean'")} AS INTEGER) AS edits FROM (SELECT unnest({WORDS}) AS word FROM documents) WHERE {distance_sql('word', "'herean'")} <= 1 GROUP BY 1")
def ql_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words within one edit of a term, by what is left of words when letters are deleted."""
    counted = ql_index(spark, sf_dir)
    near = ix.near_words(counted, spark.range(1).select(F.lit("herean").alias("asked")))
    return counted.join(F.broadcast(near), "word").select("word", F.col("total").alias("n"), F.col("edits").cast("int").alias("edits"))


@theme.add(f"""
WITH v AS (SELECT DISTINCT unnest({WORDS}) AS word FROM documents), a AS (SELECT DISTINCT unnest({WORDS}) AS asked FROM benchmark WHERE item_id % 10 = 0),
     m AS (SELECT asked, CASE WHEN length(asked) < 4 OR regexp_full_match(asked, '\\p{{N}}+') THEN 0 WHEN length(asked) < 8 THEN 1 ELSE 2 END AS most FROM a)
SELECT asked, word, CAST({distance_sql('asked', 'word')} AS INTEGER) AS edits FROM m JOIN v ON abs(length(asked) - length(word)) <= most AND {distance_sql('asked', 'word')} <= most""")
def ql_typos_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that each word of a stated set of items (ids divisible by 10) may be misspelt for."""
    words = table(spark, sf_dir, "benchmark").filter("item_id % 10 = 0").select(F.explode(T.words(F.col("text"))).alias("asked"))
    return ix.near_words(ql_index(spark, sf_dir), words).select("asked", "word", F.col("edits").cast("int").alias("edits"))


@theme.add("""
SELECT kind, value, n FROM (SELECT 'brand' AS kind, p_brand AS value, count(*) AS n FROM part WHERE lower(p_brand) LIKE 'br%' GROUP BY 2 UNION ALL SELECT 'nation', n_name, count(*) FROM nation WHERE lower(n_name) LIKE '%an%' GROUP BY 2
UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer WHERE lower(c_mktsegment) LIKE 'b%' GROUP BY 2) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) <= 5""")
def ql_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five suggestions of each of three kinds."""
    kinds = {"brand": ("part", "p_brand", "br%"), "nation": ("nation", "n_name", "%an%"), "segment": ("customer", "c_mktsegment", "b%")}
    out = None
    for kind, (name, column, like) in kinds.items():
        rows = table(spark, sf_dir, name).filter(F.lower(column).like(like)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))).filter("place <= 5").drop("place")


@theme.add(f"SELECT item, event_id, value FROM {EVENTS} QUALIFY row_number() OVER (PARTITION BY item ORDER BY value DESC, event_id) = 1")
def ql_distinct_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each item."""
    return distinct_best(events(spark, sf_dir), "item", [F.desc("value"), F.col("event_id")]).select("item", "event_id", "value")


@theme.add(f"SELECT user_id, count(*) FILTER (WHERE event_id > seen) AS fresh, max(event_id) AS last_id FROM {EVENTS} JOIN (SELECT user_id, max(event_id) AS seen FROM events WHERE event_type = 'click' GROUP BY 1) USING (user_id) GROUP BY 1")
def ql_saved_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits of a saved search are newer than the last one seen; one pass over each user's rows."""
    seen = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(Window.partitionBy("user_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", seen.alias("seen")).filter("seen is not null")
    return rows.groupBy("user_id").agg(F.count_if(F.col("event_id") > F.col("seen")).alias("fresh"), F.max("event_id").alias("last_id"))


@theme.add("""
SELECT event_id, first_click FROM (SELECT event_id, user_id FROM events WHERE event_type = 'view') v
LEFT JOIN LATERAL (SELECT min(c.event_id) AS first_click FROM events c WHERE c.event_type = 'click' AND c.user_id = v.user_id AND c.event_id > v.event_id) ON true""")
def ql_click_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first click of the same user after each view: an as-of join by a window that looks ahead."""
    after = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    click = F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).over(after)
    return table(spark, sf_dir, "events").filter("event_type in ('view', 'click')").select("event_id", "event_type", click.alias("first_click")).filter("event_type = 'view'").drop("event_type")


@theme.add("SELECT p_type AS query, count(*) AS asked, count_if(p_retailprice > 1500) AS dear, round(100.0 * count_if(p_size < 5) / count(*), 2) AS small_rate FROM part GROUP BY 1 HAVING count(*) >= 5 AND count_if(p_size > 48) = 0")
def ql_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent queries of which none had some outcome."""
    n = F.count(F.lit(1))
    rolled = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("query")).agg(
        n.alias("asked"), F.count_if(F.col("p_retailprice") > 1500).alias("dear"),
        F.round(100.0 * F.count_if(F.col("p_size") < 5) / n, 2).alias("small_rate"),
        F.count_if(F.col("p_size") > 48).alias("large")
    )
    return rolled.filter("asked >= 5 and large = 0").drop("large")


@theme.add("SELECT doc_id, translate(replace(lower(text), 'ß', 'ss'), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy') = lower(text) AS plain, md5(translate(replace(lower(text), 'ß', 'ss'), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy')) AS folded_md5 FROM documents")
def txt_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts folded to plain lower-case letters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"), T.folded(F.col("text")).alias("f"))
    return rows.select("doc_id", (F.col("f") == F.col("low")).alias("plain"), F.md5(F.col("f").cast("binary")).alias("folded_md5"))


@theme.add(r"""
SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""")
def txt_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages without markup."""
    rows = table(spark, sf_dir, "pages").select("page_id", T.stripped_html(F.col("html")).alias("t"))
    return rows.select("page_id", F.char_length("t").cast("long").alias("chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@theme.add(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(ceil(len(w) / 220.0) AS BIGINT) AS minutes, CAST(len(regexp_extract_all(text, '[.!?]')) AS BIGINT) AS stops FROM (SELECT doc_id, text, {WORDS} AS w FROM documents)")
def txt_read_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, minutes to read and sentence ends."""
    n = F.size(T.words(F.col("text")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", n.cast("long").alias("words"), F.ceil(n / 220.0).alias("minutes"),
        F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("stops")
    )


LEXICON = {"idiot": 3, "moron": 3, "clown": 2, "stupid": 2, "trash": 1}


@theme.add(f"SELECT doc_id, score, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS level FROM (SELECT doc_id, CAST({' + '.join(f'''{n} * len(list_filter(w, lambda x: x = '{t}'))''' for t, n in LEXICON.items())} AS BIGINT) AS score FROM (SELECT doc_id, {WORDS} AS w FROM documents))")
def txt_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted lexicon over whole words, with levels."""
    weights = F.create_map(*(F.lit(x) for pair in LEXICON.items() for x in pair))
    score = F.aggregate(T.words(F.col("text")), F.lit(0).cast("long"), lambda s, w: s + F.coalesce(F.try_element_at(weights, w), F.lit(0)))
    rows = table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))
    return rows.withColumn("level", F.when(F.col("score") >= 6, "high").when(F.col("score") >= 3, "medium").when(F.col("score") > 0, "low").otherwise("none"))


@theme.add(r"SELECT page_id, CAST(opened AS BIGINT) AS opened, CAST(closed AS BIGINT) AS closed, opened = closed AS balanced, CAST(links AS BIGINT) AS links FROM (SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS opened, len(regexp_extract_all(html, '</p>')) AS closed, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS links FROM pages)")
def txt_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of opened and closed paragraphs, and distinct links."""
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    links = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).cast("long")
    rows = table(spark, sf_dir, "pages").select("page_id", count("<p[ >]").alias("opened"), count("</p>").alias("closed"), links.alias("links"))
    return rows.withColumn("balanced", F.col("opened") == F.col("closed"))


@theme.add("SELECT word, count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(" + WORDS + ") AS word FROM documents) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 20")
def txt_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and total frequency of words that are in twenty documents or more, from the index."""
    return ql_index(spark, sf_dir).filter("docs >= 20")


@theme.add("SELECT quality AS risk, count(*) AS n, CAST(sum(CASE WHEN CASE quality WHEN 1 THEN 180 ELSE 365 END < doc_id % 400 THEN 1 ELSE 0 END) AS BIGINT) AS due FROM labels GROUP BY 1")
def txt_review_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents are due for review by the interval of their level."""
    interval = F.when(F.col("quality") == 1, 180).otherwise(365)
    return table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("risk")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(interval < F.col("doc_id") % 400).alias("due")
    )


@theme.add("SELECT 'documents' AS kind, doc_id AS id FROM documents WHERE n_chars > 5000 UNION SELECT 'pages', page_id FROM pages WHERE length(html) > 5000 UNION SELECT 'documents', doc_id FROM labels WHERE toxic = 1")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of results put together without repeats."""
    a = table(spark, sf_dir, "documents").filter("n_chars > 5000").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"))
    b = table(spark, sf_dir, "pages").filter(F.char_length("html") > 5000).select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"))
    return a.unionByName(b).unionByName(table(spark, sf_dir, "labels").filter("toxic = 1").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"))).distinct()


@theme.add("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one table that another lacks."""
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@theme.add(f"SELECT a.user_id AS a, b.user_id AS b, count(*) AS common FROM (SELECT DISTINCT user_id, item FROM {EVENTS} WHERE event_type = 'purchase') a JOIN (SELECT DISTINCT user_id, item FROM {EVENTS} WHERE event_type = 'purchase') b USING (item) WHERE a.user_id % 100 = 0 AND b.user_id <> a.user_id GROUP BY 1, 2")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items a stated set of users share with each other user."""
    held = materialised(events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "item").distinct(), "held")
    return overlaps(held, int(spark.conf.get("spark.sql.shuffle.partitions")))


def overlaps(held: DataFrame, parts: int, most: int = 1 << 18) -> DataFrame:
    """a, b and common of the asked users (a, ids divisible by 100) with all others, over distinct user_id and item.

    An item's pairs are its asked users times its users, which grows faster than the rows, so what a task counts is bounded by pairs: an
    item's users are dealt over shards, and shards over as many tasks as the pairs want, so many each in expectation.
    """
    pairs = F.count(F.lit(1)) * F.count_if(F.col("user_id") % 100 == 0)
    largest, total = held.groupBy("item").agg(pairs.alias("pairs")).agg(F.coalesce(F.max("pairs"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    shards, tasks = 1 + largest // most, max(parts, 1 + total // most)
    theirs = held.select(F.col("user_id").alias("b"), "item", F.pmod(F.xxhash64("user_id"), F.lit(shards)).alias("shard")).repartition(tasks, "item", "shard")
    asked = held.filter("user_id % 100 = 0").select(F.col("user_id").alias("a"), "item", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")).repartition(tasks, "item", "shard")
    return asked.join(theirs, ["item", "shard"]).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
