"""Hotness, related items and recommendations, composed of sums per item and per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.functions.text import excerpt
from agoraspark.operators import cells
from agoraspark.operators.sequences import diversified
from agoraspark.operators.vectors import cosine_top_k, cosine_within
from agoraspark.plans.base import AS_OF, EVENTS, Theme, events, table
from agoraspark.plans.vectors import COS, MET

theme = Theme()
NOW = f"TIMESTAMP '{AS_OF}'"
# Items are viewed (view), replied to (purchase), reacted to (click) and read for some time (signup, value in seconds).
# Fixed weights of the score: replies 6, reactions 3, a quarter of the mean seconds read up to 300.
HEAT = f"""(SELECT item, log10(1 + uniques + 6.0 * replies + 3.0 * reactions + 0.25 * least(coalesce(dwell, 0), 300)) + greatest(0.0, 1 - date_sub('hour', last_event, {NOW}) / 168.0) - date_sub('day', last_event, {NOW}) / 365.0 AS hotness,
       date_sub('day', last_event, {NOW}) AS age
FROM (SELECT item, count(DISTINCT CASE WHEN event_type = 'view' THEN coalesce('u' || nullif(user_id, 7), 's' || (event_id % 100)) END) AS uniques, count_if(event_type = 'purchase') AS replies, count_if(event_type = 'click') AS reactions,
             avg(CASE WHEN event_type = 'signup' THEN value END) AS dwell, max(ts) AS last_event FROM {EVENTS} GROUP BY 1))"""


def heat(rows: DataFrame) -> DataFrame:
    """item, hotness and age in days of events (item, user_id, event_id, event_type, value, ts)."""
    kind = lambda k: F.col("event_type") == k
    viewer = F.coalesce(
        F.concat(F.lit("u"), F.nullif("user_id", F.lit(7).cast("long")).cast("string")),
        F.concat(F.lit("s"), (F.col("event_id") % 100).cast("string"))
    )
    rolled = rows.groupBy("item").agg(
        F.count_distinct(F.when(kind("view"), viewer)).alias("uniques"),
        F.count_if(kind("purchase")).alias("replies"),
        F.count_if(kind("click")).alias("reactions"),
        F.avg(F.when(kind("signup"), F.col("value"))).alias("dwell"),
        F.max("ts").alias("last_event"),
    )
    since = lambda unit: F.timestamp_diff(unit, F.col("last_event"), F.lit(AS_OF).cast("timestamp_ntz"))
    score = F.log10(1 + F.col("uniques") + 6.0 * F.col("replies") + 3.0 * F.col("reactions") + 0.25 * F.least(F.coalesce("dwell", F.lit(0.0)), F.lit(300.0)))
    return rolled.select("item", (score + F.greatest(F.lit(0.0), 1 - since("HOUR") / 168.0) - since("DAY") / 365.0).alias("hotness"), since("DAY").alias("age"))


@theme.add(f"""
SELECT id, round(coalesce(hotness, CASE WHEN old > 0.01 THEN 0.9 * old ELSE old END), 6) AS hotness, hotness IS NOT NULL AS touched
FROM (SELECT p_partkey AS id, p_size / 10.0 AS old FROM part) LEFT JOIN {HEAT} ON item = id""")
def rec_hotness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hotness of every item: scored anew where it had events, nine tenths of what it was elsewhere."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") / 10.0).alias("old"))
    faded = F.when(F.col("old") > 0.01, 0.9 * F.col("old")).otherwise(F.col("old"))
    both = old.join(heat(events(spark, sf_dir)), F.col("item") == F.col("id"), "left")
    return both.select("id", F.round(F.coalesce("hotness", faded), 6).alias("hotness"), F.col("hotness").isNotNull().alias("touched"))


@theme.add(f"""
SELECT query, id, i AS place, round(score, 6) AS score FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS i FROM {MET} WHERE score >= 0.3) WHERE i <= 3""")
def rec_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near copies of each query, three at most, as a list apart from what is related."""
    rows = table(spark, sf_dir, "embeddings")
    top = cosine_top_k(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding", 3, 0.3)
    return top.select("query", "id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@theme.add(f"""
WITH t AS (SELECT query, id, score, q_label, v_label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS i FROM {MET}) WHERE i <= 32),
q AS (SELECT p_partkey AS id, p_size / (p_size + 6.0) AS quality FROM part),
r AS (SELECT query, t.id, 0.72 * score + 0.20 * coalesce(quality, 0) + 0.08 * least(1.0, (CASE WHEN q_label = v_label THEN 1 ELSE 0 END + CASE WHEN query % 3 = t.id % 3 THEN 1 ELSE 0 END) / 2.0) AS rank FROM t LEFT JOIN q ON q.id = t.id WHERE score < 0.3)
SELECT query, id, round(rank, 6) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(rank, 6) DESC, id) <= 8""")
def rec_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best of what is similar but no copy: similarity, quality and shared tags in fixed shares."""
    rows = table(spark, sf_dir, "embeddings")
    top = cosine_top_k(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding", 32).filter("score < 0.3")
    tags = rows.select(
        "vec_id",
        F.array(F.concat(F.lit("l"), F.col("label").cast("string")), F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string"))).alias("tags")
    )
    tagged = top.join(
        tags.select(F.col("vec_id").alias("query"), F.col("tags").alias("ours")), "query"
    ).join(tags.select(F.col("vec_id").alias("id"), F.col("tags").alias("theirs")), "id")
    quality = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") / (F.col("p_size") + 6.0)).alias("quality"))
    overlap = F.size(F.array_intersect("ours", "theirs"))
    rank = 0.72 * F.col("score") + 0.20 * F.coalesce("quality", F.lit(0.0)) + 0.08 * F.least(F.lit(1.0), overlap / 2.0)
    ranked = tagged.join(quality, "id", "left").select("query", "id", F.round(rank, 6).alias("rank"))
    return ranked.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), "id"))).filter("i <= 8").drop("i")


@theme.add(f"""
WITH e AS (SELECT DISTINCT user_id, item FROM {EVENTS} WHERE event_type = 'view'), c AS (SELECT a.item AS a, b.item AS b, count(*) AS w FROM e a JOIN e b ON a.user_id = b.user_id AND a.item <> b.item GROUP BY 1, 2 HAVING count(*) >= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS i FROM c WHERE a % 10 = 0), t AS (SELECT a, b, 0.55 * w / max(w) OVER (PARTITION BY a) AS co FROM n WHERE i <= 100),
v AS (SELECT q.vec_id AS a, w.vec_id AS b, {COS.format('q.embedding', 'w.embedding')} AS sim FROM embeddings q JOIN embeddings w ON q.vec_id <> w.vec_id WHERE q.vec_id IN (SELECT item FROM e WHERE item % 10 = 0)),
u AS (SELECT coalesce(t.a, s.a) AS a, coalesce(t.b, s.b) AS b, coalesce(co, 0) + 0.30 * coalesce(sim, 0) AS score FROM t FULL JOIN v AS s ON t.a = s.a AND t.b = s.b)
SELECT a AS item, b AS other, round(score + 0.10 * least(1.0, hotness / 5) + 0.05 * greatest(0, 1 - age / 30.0), 6) AS score FROM u JOIN {HEAT} h ON h.item = u.b
QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score + 0.10 * least(1.0, hotness / 5) + 0.05 * greatest(0, 1 - age / 30.0), 6) DESC, b) <= 10""")
def rec_coread_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten items for each of a stated set (ids divisible by 10): co-readers against the most of them, content, activity, freshness."""
    rows = events(spark, sf_dir)
    seen = rows.filter("event_type = 'view'").select("user_id", "item").distinct()
    asked = seen.filter("item % 10 = 0").select("user_id", F.col("item").alias("a"))
    pairs = asked.join(seen.select("user_id", F.col("item").alias("b")), "user_id").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")).filter("w >= 2")
    mine = Window.partitionBy("a")
    near = pairs.withColumn("i", F.row_number().over(mine.orderBy(F.desc("w"), "b"))).filter("i <= 100").select(
        "a", "b", (0.55 * F.col("w") / F.max("w").over(mine)).alias("co")
    )
    vectors = table(spark, sf_dir, "embeddings")
    # an item's vector is that of the same id; each item that is asked is compared with all others
    queries = vectors.join(asked.select(F.col("a").alias("vec_id")).distinct(), "vec_id", "left_semi")
    alike = cosine_within(queries, vectors, "vec_id", "embedding", -1.0).select(F.col("query").alias("a"), F.col("id").alias("b"), F.col("score").alias("sim"))
    merged = near.join(alike, ["a", "b"], "full").join(heat(rows).withColumnRenamed("item", "b"), "b")
    score = F.coalesce("co", F.lit(0.0)) + 0.30 * F.coalesce("sim", F.lit(0.0)) + 0.10 * F.least(F.lit(1.0), F.col("hotness") / 5) + 0.05 * F.greatest(F.lit(0.0), 1 - F.col("age") / 30.0)
    ranked = merged.select(F.col("a").alias("item"), F.col("b").alias("other"), F.round(score, 6).alias("score"))
    return ranked.withColumn("i", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "other"))).filter("i <= 10").drop("i")


SEEDS = f"""(WITH p AS (SELECT user_id, item, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM {EVENTS} WHERE event_type = 'purchase'),
d AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS place FROM p WHERE i <= 150 GROUP BY 1, 2),
r AS (SELECT user_id, item, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM {EVENTS} WHERE event_type = 'click'),
x AS (SELECT user_id, item, 1000 + row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS place FROM r WHERE i <= 100 GROUP BY 1, 2)
SELECT user_id, item, min(place) AS place FROM (SELECT * FROM d UNION ALL SELECT * FROM x) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(place)) <= 25)"""


def seeds(rows: DataFrame, most: int = 25) -> DataFrame:
    """user_id, item: the items of a user's latest 150 purchases, the latest first, topped up from the latest 100 clicks."""

    def latest(kind: str, n: int, offset: int) -> DataFrame:
        last = rows.filter(F.col("event_type") == kind).withColumn(
            "i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
        ).filter(F.col("i") <= n)
        once = last.groupBy("user_id", "item").agg(F.max("event_id").alias("at"))
        return once.select("user_id", "item", (offset + F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at")))).alias("place"))

    both = latest("purchase", 150, 0).unionByName(latest("click", 100, 1000)).groupBy("user_id", "item").agg(F.min("place").alias("place"))
    return both.withColumn(
        "i", F.row_number().over(Window.partitionBy("user_id").orderBy("place"))
    ).filter(F.col("i") <= most).select("user_id", "item", "place")


@theme.add(f"SELECT user_id, item, CAST(place AS BIGINT) AS place FROM {SEEDS}")
def rec_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recommendation for each user starts from."""
    return seeds(events(spark, sf_dir)).select("user_id", "item", F.col("place").cast("long").alias("place"))


DIM = 64
SOUGHT = f"""(WITH s AS (SELECT user_id, item FROM {SEEDS} WHERE user_id % 10 = 0), m AS (SELECT user_id, i, avg(embedding[i + 1]::DOUBLE) AS v FROM s JOIN embeddings ON vec_id = item, range({DIM}) AS r(i) GROUP BY 1, 2)
SELECT user_id, list(v ORDER BY i) AS vector FROM m GROUP BY 1)"""
SEEN = f"(SELECT DISTINCT user_id, item FROM {EVENTS})"


@theme.add(f"""
WITH u AS (SELECT DISTINCT user_id FROM (SELECT user_id FROM events WHERE user_id % 10 = 0 UNION ALL SELECT -1)), c AS (SELECT * FROM {SOUGHT}),
v AS (SELECT vec_id AS id, embedding, label, coalesce(p_size, 0) / (coalesce(p_size, 0) + 6.0) AS quality FROM embeddings LEFT JOIN part ON p_partkey = vec_id),
x AS (SELECT c.user_id, v.id, v.label, quality, {COS.format('c.vector', 'v.embedding')} AS cos FROM c, v WHERE NOT EXISTS (SELECT 1 FROM {SEEN} s WHERE s.user_id = c.user_id AND s.item = v.id)),
p AS (SELECT user_id, id, label, 0.7 * cos + 0.3 * quality AS rank, 'your-activity' AS reason FROM x QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(cos, 12) DESC, id) <= 60),
t AS (SELECT item, 1.0 + recent / ln(2.718281828459045 + n) AS trend FROM (SELECT item, count(*) AS n, count_if(ts >= {NOW} - INTERVAL 72 HOUR) AS recent FROM {EVENTS} GROUP BY 1) WHERE recent > 0),
k AS (SELECT u.user_id, v.id, v.label, coalesce(trend, quality) AS rank, CASE WHEN trend IS NOT NULL THEN 'trending' ELSE 'top-rated' END AS reason FROM u, v LEFT JOIN t ON t.item = v.id WHERE u.user_id NOT IN (SELECT user_id FROM c)),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY round(rank, 6) DESC, id) > 3 AS spill FROM (SELECT * FROM p UNION ALL SELECT * FROM k)),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY spill, round(rank, 6) DESC, id) AS place FROM b)
SELECT user_id, id, round(rank, 6) AS rank, reason, place FROM o WHERE place <= 12""")
def rec_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve items for each of a stated set of users (ids divisible by 10) and for a stranger (-1), three of a label first.

    Users with seeds get the best of the sixty nearest to the mean of their seeds' vectors that they haven't met yet; the others
    what is trending, then what is best rated.
    """
    rows, vectors = events(spark, sf_dir), table(spark, sf_dir, "embeddings")
    asked = rows.filter("user_id % 10 = 0")
    sized = F.coalesce("p_size", F.lit(0))
    items = vectors.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("vec_id"), "left").select(
        F.col("vec_id").alias("id"), "label", (sized / (sized + 6.0)).alias("quality")
    )
    wanted = seeds(asked).join(vectors.select(F.col("vec_id").alias("item"), "embedding"), "item")
    mean = wanted.select("user_id", F.posexplode("embedding").alias("at", "x")).groupBy("user_id", "at").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs")).select(
        "user_id", F.transform("xs", lambda x: x["x"]).alias("q")
    )
    # what a user has met doesn't count; of the rest the nearest are ranked, five times as many as are shown
    met = asked.groupBy("user_id").agg(F.collect_set("item").alias("skip"))
    sought = centre.join(met, "user_id").select(F.col("user_id").alias("query"), "q", "skip")
    held = cells.kept(vectors, "vec_id", "embedding")
    fresh = cells.search(held, sought, 60).select(F.col("query").alias("user_id"), "id", "score")
    own = fresh.join(items, "id").select(
        "user_id", "id", "label", F.round(0.7 * F.col("score") + 0.3 * F.col("quality"), 6).alias("rank"),
        F.lit("your-activity").alias("reason")
    )
    recent = F.count_if(F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 72 hours"))
    trend = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), recent.alias("recent")).filter("recent > 0").select(
        F.col("item").alias("id"), (1.0 + F.col("recent") / F.log(F.lit(2.718281828459045) + F.col("n"))).alias("trend")
    )
    strangers = asked.select("user_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("user_id"))).join(
        centre.select("user_id"), "user_id", "left_anti"
    )
    # everyone without seeds gets the same list, so it is ranked once
    best = diversified(
        items.join(trend, "id", "left").select(F.lit(0).alias("all"), "id", "label", F.round(F.coalesce("trend", "quality"), 6).alias("rank"), F.when(F.col("trend").isNotNull(), "trending").otherwise("top-rated").alias("reason")).orderBy(F.desc("rank"), "id"),
        "all", [F.desc("rank"), F.col("id")], "label", 12, 3
    )
    cold = strangers.join(F.broadcast(best.select("id", "rank", "reason", "place")))
    warm = diversified(own, "user_id", [F.desc("rank"), F.col("id")], "label", 12, 3)
    columns = ["user_id", "id", "rank", "reason", F.col("place").cast("long").alias("place")]
    return warm.select(*columns).unionByName(cold.select(*columns))


@theme.add(f"""
WITH r AS (SELECT item, user_id FROM {EVENTS} WHERE event_type IN ('purchase', 'click') QUALIFY row_number() OVER (PARTITION BY item ORDER BY event_id DESC) <= 120),
u AS (SELECT item, user_id FROM (SELECT DISTINCT item, user_id FROM r WHERE item % 10 = 0) QUALIFY count(*) OVER (PARTITION BY item) >= 2),
n AS (SELECT item, count(*) AS size FROM {EVENTS} GROUP BY 1)
SELECT u.item, e.item AS other, count(*) AS co, round(count(*) / ln(2.718281828459045 + any_value(size)), 6) AS score FROM u JOIN {EVENTS} e ON e.user_id = u.user_id AND e.item <> u.item JOIN n ON n.item = e.item WHERE e.event_type IN ('purchase', 'click') GROUP BY 1, 2""")
def rec_also_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the latest participants of each of a stated set of items did elsewhere; items with one participant have none."""
    rows = events(spark, sf_dir)
    acts = rows.filter("event_type in ('purchase', 'click')")
    last = acts.filter("item % 10 = 0").withColumn("i", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("event_id")))).filter("i <= 120")
    people = last.select(F.col("item").alias("a"), "user_id").distinct().withColumn("people", F.count(F.lit(1)).over(Window.partitionBy("a"))).filter("people >= 2")
    sizes = rows.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    # a user's acts are counted per item before the join
    each = acts.groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n"))
    together = people.join(each, "user_id").filter("a <> item").groupBy("a", "item").agg(F.sum("n").alias("co")).join(sizes, "item")
    return together.select(
        F.col("a").alias("item"), F.col("item").alias("other"), "co",
        F.round(F.col("co") / F.log(F.lit(2.718281828459045) + F.col("size")), 6).alias("score")
    )


@theme.add(f"""
WITH a AS (SELECT user_id, item % 10 AS tag, sum(CAST(round(least(value, 90) * 100) AS BIGINT)) AS w FROM {EVENTS} WHERE event_type = 'view' AND value >= 4 AND user_id % 10 = 0 GROUP BY 1, 2),
f AS (SELECT user_id, tag, w / max(w) OVER (PARTITION BY user_id) AS affinity FROM a), h AS (SELECT * FROM {HEAT}), g AS (SELECT item, unnest([item % 10, item % 7]) AS tag FROM h),
s AS (SELECT DISTINCT user_id, item FROM {EVENTS} WHERE event_type IN ('view', 'signup')), u AS (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0 UNION ALL SELECT -1),
w AS (SELECT f.user_id, h.item, 0.55 * max(affinity) + 0.35 * least(any_value(hotness) / 5, 1) + 0.10 * greatest(0, 1 - any_value(age) / 30.0) AS score FROM f JOIN g USING (tag) JOIN h USING (item) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = f.user_id AND s.item = h.item) GROUP BY 1, 2),
c AS (SELECT user_id, item, hotness AS score FROM u, h WHERE user_id NOT IN (SELECT user_id FROM f))
SELECT user_id, item, round(score, 6) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item) <= 12""")
def rec_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve items for each of a stated set of users and for a stranger (-1): by the best affinity of an item's tags, or by hotness without any."""
    rows = events(spark, sf_dir)
    asked, items = rows.filter("user_id % 10 = 0"), heat(rows)
    spent = F.sum(F.round(F.least("value", F.lit(90.0)) * 100).cast("long"))
    tagged = asked.filter("event_type = 'view' and value >= 4").groupBy("user_id", (F.col("item") % 10).alias("tag")).agg(spent.alias("w"))
    affinity = tagged.select("user_id", "tag", (F.col("w") / F.max("w").over(Window.partitionBy("user_id"))).alias("affinity"))
    tags = items.select("item", F.explode(F.array(F.col("item") % 10, F.col("item") % 7)).alias("tag"))
    best = affinity.join(tags, "tag").groupBy("user_id", "item").agg(F.max("affinity").alias("affinity"))
    met = asked.filter("event_type in ('view', 'signup')").select("user_id", "item").distinct()
    score = 0.55 * F.col("affinity") + 0.35 * F.least(F.col("hotness") / 5, F.lit(1.0)) + 0.10 * F.greatest(F.lit(0.0), 1 - F.col("age") / 30.0)
    warm = best.join(met, ["user_id", "item"], "left_anti").join(items, "item").select("user_id", "item", F.round(score, 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item"))
    warm = warm.withColumn("place", place).filter("place <= 12").drop("place")
    strangers = asked.select("user_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("user_id"))).join(
        affinity.select("user_id").distinct(), "user_id", "left_anti"
    )
    hottest = items.select("item", F.round("hotness", 6).alias("score")).orderBy(F.desc("score"), "item").limit(12)
    return warm.unionByName(strangers.join(F.broadcast(hottest)).select("user_id", "item", "score"))


@theme.add("""
WITH t AS (SELECT doc_id, trim('Document ' || doc_id || chr(10) || lang || ', ' || source || chr(10) || CASE WHEN length(text) <= 600 THEN text WHEN instr(reverse(substr(text, 1, 600)), ' ') > 0 AND 600 - instr(reverse(substr(text, 1, 600)), ' ') >= 360 THEN substr(text, 1, 600 - instr(reverse(substr(text, 1, 600)), ' ')) ELSE substr(text, 1, 600) END) AS embed_text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, length(embed_text) AS chars, md5(embed_text) AS embed_md5 FROM t""")
def rec_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of a document: title, tags and an excerpt cut at a blank."""
    rows = table(spark, sf_dir, "documents").filter("text is not null and lang is not null and source is not null")
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    whole = F.trim(F.array_join(F.array(title, F.array_join(F.slice(F.array("lang", "source"), 1, 6), ", "), excerpt(F.col("text"), 600)), "\n"))
    return rows.select("doc_id", F.char_length(whole).cast("long").alias("chars"), F.md5(whole.cast("binary")).alias("embed_md5"))


@theme.add(f"""
WITH n AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ')) AS w FROM part), k AS (SELECT q.id AS query, v.id, len(list_intersect(q.w, v.w)) / len(list_distinct(list_concat(q.w, v.w)))::DOUBLE AS lexical FROM n q JOIN n v ON q.id <> v.id WHERE q.id % 100 = 0),
s AS (SELECT query, id, score AS semantic FROM {MET} WHERE score >= 0.25), b AS (SELECT query, id, lexical, semantic FROM (SELECT * FROM k WHERE lexical >= 0.6) FULL JOIN s USING (query, id)),
r AS (SELECT query, id, round(greatest(coalesce(lexical, 0), coalesce(semantic, 0)) + 0.25 * least(coalesce(lexical, 0), coalesce(semantic, 0)), 6) AS rank FROM b)
SELECT query, id, rank, CASE WHEN rank >= 1.0 THEN 'high' WHEN rank >= 0.85 THEN 'medium' ELSE 'low' END AS confidence FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank DESC, id) <= 5""")
def rec_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest duplicates of each of a stated set, by shared words of the name or by vectors, with how sure that is."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.array_distinct(F.split("p_name", " ")).alias("w"))
    # names are few and repeat, so sets of words are compared once each, where they share a word
    sets = names.select("w").distinct().withColumn("key", F.xxhash64("w"))
    asked = names.filter("id % 100 = 0").select("w").distinct().withColumn("q_key", F.xxhash64("w"))
    met = asked.select(
        "q_key", F.col("w").alias("q_w"), F.explode("w").alias("word")
    ).join(sets.select("key", "w", F.explode("w").alias("word")), "word").select("q_key", "q_w", "key", "w").distinct()
    close = met.select("q_key", "key", (F.size(F.array_intersect("q_w", "w")) / F.size(F.array_union("q_w", "w"))).alias("lexical")).filter("lexical >= 0.6")
    keyed = names.select("id", F.xxhash64("w").alias("key"))
    # only the first five of a set of equal names can be among a query's five, besides the query and what vectors bring
    first = keyed.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter("i <= 6").drop("i")
    vectors = table(spark, sf_dir, "embeddings")
    semantic = cosine_within(
        vectors.filter("vec_id % 100 = 0"), vectors, "vec_id", "embedding", 0.25
    ).select("query", "id", F.col("score").alias("semantic"))
    queries = keyed.filter("id % 100 = 0").select(F.col("id").alias("query"), F.col("key").alias("q_key"))
    by_name = queries.join(close, "q_key")
    lexical = by_name.join(first, "key").select("query", "id", "lexical").unionByName(by_name.join(semantic.select("query", "id").join(keyed, "id"), ["query", "key"]).select("query", "id", "lexical")).filter("query <> id").distinct()
    a, b = F.coalesce("lexical", F.lit(0.0)), F.coalesce("semantic", F.lit(0.0))
    ranked = lexical.join(semantic, ["query", "id"], "full").select("query", "id", F.round(F.greatest(a, b) + 0.25 * F.least(a, b), 6).alias("rank"))
    best = ranked.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), "id"))).filter("i <= 5")
    return best.select("query", "id", "rank", F.when(F.col("rank") >= 1.0, "high").when(F.col("rank") >= 0.85, "medium").otherwise("low").alias("confidence"))
