"""Vector search, hybrid scores, recommendation and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.operators import cells
from agoraspark.operators.vectors import centroids, cosine_top_k, cosine_within
from agoraspark.plans.base import AS_OF, EVENTS, Theme, events, table

theme = Theme()
DIM = 64
#: Cosine of two vectors in SQL, and all pairs of the query set with the rows.
COS = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_inner_product({1}::DOUBLE[], {1}::DOUBLE[])))"
MET = f"(SELECT q.vec_id AS query, v.vec_id AS id, q.label AS q_label, v.label AS v_label, {COS.format('q.embedding', 'v.embedding')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)"


@theme.add("SELECT count(*) AS vectors, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE list_inner_product(embedding, embedding) > 0")
def vec_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cells of the vectors hold, which are built here if no search has done it before."""
    held = cells.kept(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return held.vectors.agg(F.count(F.lit(1)).alias("vectors"), F.sum("id").alias("ids"))


def _top(spark: SparkSession, sf_dir: str, k: int, floor: float = -1.0) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return cosine_top_k(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding", k, floor)


@theme.add(f"SELECT query, id, round(score, 6) AS score, i AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS i FROM {MET} WHERE score >= 0.1) WHERE i <= 8")
def vec_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most similar vectors of each query, above a floor."""
    return _top(spark, sf_dir, 8, 0.1).select("query", "id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@theme.add(f"SELECT query, count_if(score >= 0.3) AS near, count_if(score < 0.3) AS related FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS i FROM {MET}) WHERE i <= 20 GROUP BY 1")
def vec_near_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the best twenty count as copies, and how many as related."""
    top = _top(spark, sf_dir, 20)
    return top.groupBy("query").agg(F.count_if(F.col("score") >= 0.3).alias("near"), F.count_if(F.col("score") < 0.3).alias("related"))


@theme.add(f"""
WITH m AS (SELECT label, i AS dim, avg(embedding[i + 1]::DOUBLE) AS v FROM embeddings, range({DIM}) AS r(i) WHERE len(embedding) = {DIM} GROUP BY 1, 2)
SELECT label, CAST(dim AS INTEGER) AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM m""")
def vec_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label at unit length."""
    return centroids(table(spark, sf_dir, "embeddings"), "label", "embedding", DIM).select(
        "label", F.col("at").alias("dim"), F.round("value", 6).alias("value")
    )


@theme.add(f"""
WITH r AS (SELECT query, min(i) FILTER (WHERE q_label = v_label) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS i FROM {MET}) WHERE i <= 50 GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0.0 END), 6) AS r1, round(avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END), 6) AS r5, round(avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0.0 END), 6) AS r10, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr FROM r""")
def vec_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1, 5 and 10 and mean reciprocal rank of the first hit of the same label among fifty."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = _top(spark, sf_dir, 50).join(
        labels.select(F.col("vec_id").alias("query"), F.col("label").alias("q_label")), "query"
    ).join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("v_label")), "id")
    first = top.groupBy("query").agg(F.min(F.when(F.col("q_label") == F.col("v_label"), F.col("place"))).alias("hit"))
    at = lambda k: F.round(F.avg(F.when(F.col("hit") <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}")
    return first.agg(F.count(F.lit(1)).alias("queries"), at(1), at(5), at(10), F.round(F.avg(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))), 6).alias("mrr"))


# Fixed weights, here and in the queries below: halves of quality at a score of 6; activity 1.5, 1 and 0.5; rank 2.2, 1.4, 0.6, 3 and 0.5;
# feed 0.55, 0.35 and 0.10; hybrid the better score and a quarter of the other.
QUALITY = "CASE WHEN s > 0 THEN s / (s + 6.0) ELSE least(1.0, 0.1 * (1.5 * ln(1 + buys) + ln(1 + clicks) + 0.5 * ln(1 + views))) END"
ITEMS = f"(SELECT item, count_if(event_type = 'purchase') AS buys, count_if(event_type = 'click') AS clicks, count_if(event_type = 'view') AS views, CAST(count_if(event_type = 'signup') AS BIGINT) - count_if(event_type = 'error') AS s, count(*) AS n, max(ts) AS last_ts FROM {EVENTS} GROUP BY 1)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return (
        events(spark, sf_dir)
        .groupBy("item")
        .agg(
            kind("purchase").alias("buys"), kind("click").alias("clicks"), kind("view").alias("views"),
            (kind("signup") - kind("error")).alias("s"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")
        )
    )


@theme.add(f"SELECT item, s, round({QUALITY}, 6) AS quality FROM {ITEMS}")
def vec_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of an item from its score, or from activity where that isn't positive."""
    activity = 1.5 * F.log(1 + F.col("buys")) + F.log(1 + F.col("clicks")) + 0.5 * F.log(1 + F.col("views"))
    quality = F.when(F.col("s") > 0, F.col("s") / (F.col("s") + 6.0)).otherwise(F.least(F.lit(1.0), 0.1 * activity))
    return _items(spark, sf_dir).select("item", "s", F.round(quality, 6).alias("quality"))


@theme.add(f"SELECT item, round(2.2 * ln(1 + buys) + 1.4 * ln(1 + clicks) + 0.6 * ln(1 + views) + 3 * exp(-date_diff('day', last_ts, TIMESTAMP '{AS_OF}') / 365.0) + 0.5 * least(10, n / 10.0), 4) AS rank_score FROM {ITEMS}")
def vec_rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static rank from logarithms of counts, age and a capped activity."""
    days = F.date_diff(F.lit(AS_OF).cast("timestamp_ntz"), F.col("last_ts"))
    score = 2.2 * F.log(1 + F.col("buys")) + 1.4 * F.log(1 + F.col("clicks")) + 0.6 * F.log(1 + F.col("views")) + 3 * F.exp(-days / 365.0) + 0.5 * F.least(F.lit(10.0), F.col("n") / 10.0)
    return _items(spark, sf_dir).select("item", F.round(score, 4).alias("rank_score"))


@theme.add(f"""
SELECT user_id, item, round(w / max(w) OVER (PARTITION BY user_id), 6) AS affinity FROM
(SELECT user_id, item, CAST(sum(CAST(round(least(value, 90) * 100) AS BIGINT)) AS BIGINT) AS w FROM {EVENTS} WHERE event_type = 'view' AND value >= 4 GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, item) <= 10""")
def vec_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affinity of users to items: capped time, the ten best, relative to the greatest."""
    rolled = events(spark, sf_dir).filter("event_type = 'view' and value >= 4").groupBy("user_id", "item").agg(F.sum(F.round(F.least("value", F.lit(90.0)) * 100).cast("long")).alias("w"))
    mine = Window.partitionBy("user_id")
    ranked = rolled.withColumns({"place": F.row_number().over(mine.orderBy(F.desc("w"), "item")), "most": F.max("w").over(mine)})
    return ranked.filter("place <= 10").select("user_id", "item", F.round(F.col("w") / F.col("most"), 6).alias("affinity"))


@theme.add(f"""
WITH h AS (SELECT item, least(n / 10.0, 5) / 5 AS hot, greatest(0, 1 - date_sub('hour', last_ts, TIMESTAMP '{AS_OF}') / 720.0) AS fresh FROM {ITEMS}),
a AS (SELECT user_id, item % 10 AS tag, max(value) / 100 AS affinity FROM {EVENTS} WHERE event_type = 'view' GROUP BY 1, 2),
s AS (SELECT DISTINCT user_id, item FROM {EVENTS}),
c AS (SELECT a.user_id, h.item, 0.55 * a.affinity + 0.35 * h.hot + 0.10 * h.fresh AS score FROM a JOIN h ON h.item % 10 = a.tag WHERE a.user_id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = a.user_id AND s.item = h.item))
SELECT user_id, item, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item) <= 12""")
def vec_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve items a user hasn't met, by affinity to their tag, activity and freshness, for a stated set of users."""
    hours = F.timestamp_diff("HOUR", F.col("last_ts"), F.lit(AS_OF).cast("timestamp_ntz"))
    items = _items(spark, sf_dir).select(
        "item", (F.col("item") % 10).alias("tag"), (F.least(F.col("n") / 10.0, F.lit(5.0)) / 5).alias("hot"),
        F.greatest(F.lit(0.0), 1 - hours / 720.0).alias("fresh")
    )
    rows = events(spark, sf_dir).filter("user_id % 100 = 0")
    affinity = rows.filter("event_type = 'view'").groupBy("user_id", (F.col("item") % 10).alias("tag")).agg((F.max("value") / 100).alias("affinity"))
    fresh = affinity.join(items, "tag").join(rows.select("user_id", "item").distinct(), ["user_id", "item"], "left_anti")
    scored = fresh.select("user_id", "item", F.round(0.55 * F.col("affinity") + 0.35 * F.col("hot") + 0.10 * F.col("fresh"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item"))
    return scored.withColumn("place", place).filter("place <= 12").drop("place")


@theme.add(f"""
WITH n AS (SELECT item, count(*) AS size FROM {EVENTS} GROUP BY 1), u AS (SELECT DISTINCT user_id FROM {EVENTS} WHERE item = 7 AND event_type = 'purchase'),
c AS (SELECT item, count(*) AS co FROM {EVENTS} JOIN u USING (user_id) WHERE item <> 7 GROUP BY 1 HAVING count(*) >= 2)
SELECT item, co, round(co / ln(2.718281828459045 + size), 6) AS score FROM c JOIN n USING (item)""")
def vec_also(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the buyers of one item also met, against how much there is of it."""
    rows = events(spark, sf_dir)
    sizes = rows.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    buyers = rows.filter("item = 7 and event_type = 'purchase'").select("user_id").distinct()
    together = rows.filter("item <> 7").join(buyers, "user_id").groupBy("item").agg(F.count(F.lit(1)).alias("co")).filter("co >= 2")
    return together.join(sizes, "item").select("item", "co", F.round(F.col("co") / F.log(F.lit(2.718281828459045) + F.col("size")), 6).alias("score"))


@theme.add(f"SELECT item, recent, round(recent / ln(2.718281828459045 + n), 6) AS trend FROM (SELECT item, count(*) AS n, count_if(ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS recent FROM {EVENTS} GROUP BY 1) WHERE recent > 0")
def vec_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of the last week against that of all time."""
    recent = F.count_if(F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 7 days"))
    rolled = events(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("n"), recent.alias("recent")).filter("recent > 0")
    return rolled.select("item", "recent", F.round(F.col("recent") / F.log(F.lit(2.718281828459045) + F.col("n")), 6).alias("trend"))


@theme.add(f"""
WITH k AS (SELECT p_partkey AS id, p_retailprice / 2100.0 AS lexical FROM part WHERE p_retailprice > 1260), s AS (SELECT id, max(score) AS semantic FROM {MET} WHERE score >= 0.25 GROUP BY 1)
SELECT id, round(greatest(coalesce(lexical, 0), coalesce(semantic, 0)) + 0.25 * least(coalesce(lexical, 0), coalesce(semantic, 0)), 6) AS rank, lexical IS NOT NULL AS by_words, semantic IS NOT NULL AS by_meaning FROM k FULL JOIN s USING (id)""")
def vec_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result lists merged by key: the better score plus a quarter of the other."""
    lexical = table(spark, sf_dir, "part").filter("p_retailprice > 1260").select(
        F.col("p_partkey").cast("long").alias("id"), (F.col("p_retailprice") / 2100.0).alias("lexical")
    )
    rows = table(spark, sf_dir, "embeddings")
    semantic = cosine_within(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding", 0.25).groupBy("id").agg(F.max("score").alias("semantic"))
    a, b = F.coalesce("lexical", F.lit(0.0)), F.coalesce("semantic", F.lit(0.0))
    both = lexical.join(semantic, "id", "full")
    return both.select(
        "id", F.round(F.greatest(a, b) + 0.25 * F.least(a, b), 6).alias("rank"), F.col("lexical").isNotNull().alias("by_words"),
        F.col("semantic").isNotNull().alias("by_meaning")
    )
