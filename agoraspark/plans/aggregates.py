"""Grouped and global aggregates: conditional, distinct, shares, percentiles, facets, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.operators.percentiles import exact_percentiles
from agoraspark.operators.prefix import running
from agoraspark.plans.base import AS_OF, EVENTS, Theme, events, table

theme = Theme()
TYPE_WEIGHTS = {"purchase": 5.0, "click": 2.0, "view": 1.0}


@theme.add(f"""
SELECT item, count_if(event_type = 'view') AS views, count_if(event_type = 'click') AS clicks, count_if(event_type = 'purchase') AS purchases,
       count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewers, round(avg(CASE WHEN event_type = 'view' THEN value END), 8) AS avg_view_value
FROM {EVENTS} GROUP BY item""")
def agg_event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts, a conditional distinct count and a conditional mean per item."""
    of = lambda kind: F.col("event_type") == kind
    return (
        events(spark, sf_dir)
        .groupBy("item")
        .agg(
            F.count_if(of("view")).alias("views"),
            F.count_if(of("click")).alias("clicks"),
            F.count_if(of("purchase")).alias("purchases"),
            F.count_distinct(F.when(of("view"), F.col("user_id"))).alias("viewers"),
            F.round(F.avg(F.when(of("view"), F.col("value"))), 8).alias("avg_view_value"),
        )
    )


@theme.add("""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total, round(sum(r_regionkey * o_totalprice), 2) AS weighted
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def agg_joined_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of facts and sum of a joined attribute along a chain of inner joins; facts are summed by customer before they are joined."""
    facts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    rows = facts.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name").agg(
        F.sum("orders").alias("orders"), F.round(F.sum("total"), 2).alias("total"), F.round(F.sum(F.col("r_regionkey") * F.col("total")), 2).alias("weighted")
    )


@theme.add(f"SELECT item, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {EVENTS} GROUP BY item, event_type")
def agg_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two keys."""
    return events(spark, sf_dir).groupBy("item", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@theme.add(f"SELECT event_type, count(*) AS pairs FROM (SELECT DISTINCT event_type, user_id, item FROM {EVENTS} WHERE user_id IS NOT NULL) GROUP BY event_type")
def agg_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user, item) pairs per type; pairs with a null don't count."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.count_distinct("user_id", "item").alias("pairs"))


@theme.add("SELECT l_suppkey AS suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def agg_two_distincts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct counts over one fan-out."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders")
    )


@theme.add("""
SELECT c_custkey AS custkey, count(o_orderkey) AS orders, max(c_acctbal) AS balance, round(coalesce(sum(o_totalprice), 0), 2) AS spent
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def agg_left_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts per row of the left side, zero where there is none; the facts are summed before the join."""
    facts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))
    rows = table(spark, sf_dir, "customer").join(facts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(
        F.col("c_custkey").alias("custkey"), F.coalesce("orders", F.lit(0)).cast("long").alias("orders"),
        F.col("c_acctbal").alias("balance"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent")
    )


@theme.add("""
SELECT user_id, count_if(event_type = 'purchase') AS purchases, count(*) AS n FROM events
GROUP BY user_id HAVING count_if(event_type = 'purchase') >= 2 AND sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) <= 8""")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on aggregates."""
    rolled = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "signup").alias("signups"), F.count(F.lit(1)).alias("n")
    )
    return rolled.filter("purchases >= 2 and signups <= 8").select("user_id", "purchases", "n")


@theme.add("""
SELECT l_orderkey AS orderkey, count(DISTINCT l_returnflag) AS flags, count(*) AS lines FROM lineitem
GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2 AND count_if(l_returnflag NOT IN ('A', 'R')) = 0""")
def agg_exact_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational division: orders whose flags are exactly A and R."""
    wanted = ["A", "R"]
    rolled = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        F.count_distinct("l_returnflag").alias("flags"), F.count_if(~F.col("l_returnflag").isin(wanted)).alias("others"),
        F.count(F.lit(1)).alias("lines")
    )
    return rolled.filter((F.col("flags") == len(wanted)) & (F.col("others") == 0)).select("orderkey", "flags", "lines")


@theme.add("""
SELECT c_custkey AS custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders,
       (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders FROM customer""")
def agg_counter_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of every customer from the base rows, in one pass over them."""
    facts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders")
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(facts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("custkey"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("orders", "open_orders")))


@theme.add("""
SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderdate AS orderdate, o_totalprice AS price
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def agg_latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer, ties by key; a maximum, which combines before the shuffle."""
    latest = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(latest)
    return rows.select("custkey", F.col("x.o_orderkey").alias("orderkey"), F.col("x.o_orderdate").alias("orderdate"), F.col("x.o_totalprice").alias("price"))


DELTA = "CASE event_type WHEN 'purchase' THEN CAST(round(value * 100) AS BIGINT) WHEN 'error' THEN -CAST(round(value * 100) AS BIGINT) ELSE 0 END"


@theme.add(f"SELECT user_id, CAST(sum({DELTA}) AS BIGINT) AS balance, CAST(sum(greatest({DELTA}, 0)) AS BIGINT) AS lifetime FROM events GROUP BY user_id")
def agg_signed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed sum and sum of the positive part, in hundredths."""
    delta = F.expr(DELTA)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(delta).alias("balance"), F.sum(F.greatest(delta, F.lit(0))).alias("lifetime"))


@theme.add("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM events GROUP BY event_type")
def agg_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all rows in per cent; the window is over one row per type."""
    rolled = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = rolled.agg(F.sum("n").alias("total"))  # one row
    return rolled.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("share"))


@theme.add("""
SELECT count(*) AS n, round(100.0 * count_if(event_type = 'error') / count(*), 2) AS error_rate, round(100.0 * count_if(event_type = 'click') / greatest(count_if(event_type = 'view'), 1), 2) AS click_rate,
       round(avg(value), 8) AS avg_value, max(value) AS max_value FROM events""")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of global figures."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.try_divide(100.0 * of("error"), F.count(F.lit(1))), 2).alias("error_rate"),
        F.round(100.0 * of("click") / F.greatest(of("view"), F.lit(1)), 2).alias("click_rate"),
        F.round(F.avg("value"), 8).alias("avg_value"),
        F.max("value").alias("max_value"),
    )


@theme.add("""
SELECT event_type, share, n, value FROM
(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
(VALUES (0.5::DOUBLE), (0.9), (0.95), (0.99)) AS s(share)
WHERE i = least(CAST(floor(n * share) AS BIGINT), n - 1)""")
def agg_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest-rank percentiles per type over all rows."""
    return exact_percentiles(table(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.9, 0.95, 0.99])


@theme.add("""
WITH h AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER () AS total FROM h)
SELECT min(v) FILTER (WHERE upto >= 0.1 * total) AS p10, min(v) FILTER (WHERE upto >= 0.5 * total) AS p50, min(v) FILTER (WHERE upto >= 0.9 * total) AS p90,
       min(v) FILTER (WHERE upto >= 0.99 * total) AS p99, round(sum(v * n) / sum(n), 4) AS mean, max(v) AS most FROM c""")
def agg_histogram_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles, mean and maximum from a histogram, which has one row per distinct quantity."""
    histogram = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("v")).count()
    total = histogram.agg(F.sum("count").alias("total"))  # one row
    tally = running(histogram, [], ["v"], F.col("count"), "upto").crossJoin(F.broadcast(total))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("v")))
    return tally.agg(
        at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"),
        F.round(F.sum(F.col("v") * F.col("count")) / F.sum("count"), 4).alias("mean"), F.max("v").alias("most")
    )


@theme.add("SELECT threshold, round(avg(CASE WHEN n_chars > threshold THEN 1.0 ELSE 0.0 END), 6) AS share FROM documents, (VALUES (100::BIGINT), (1000), (5000), (20000)) AS t(threshold) GROUP BY threshold")
def agg_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents longer than each threshold, in one pass."""
    thresholds = [100, 1000, 5000, 20000]
    one = table(spark, sf_dir, "documents").agg(*(F.avg((F.col("n_chars") > t).cast("double")).alias(str(t)) for t in thresholds))
    listed = F.array(*(F.struct(F.lit(t).cast("long").alias("threshold"), F.round(F.col(str(t)), 6).alias("share")) for t in thresholds))
    return one.select(F.inline(listed))


@theme.add("""
SELECT marker, CAST(sum(n) AS BIGINT) AS occurrences, count(*) FILTER (WHERE n > 0) AS documents, count(DISTINCT CASE WHEN n > 0 THEN source END) AS sources
FROM (SELECT source, 'digits' AS marker, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents UNION ALL
      SELECT source, 'mail', len(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')) FROM documents UNION ALL
      SELECT source, 'license', len(regexp_extract_all(text, 'licensed under')) FROM documents) GROUP BY marker""")
def agg_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each marker: occurrences, documents and sources that hold it; counted once per document, then summed."""
    markers = {"digits": "[0-9]+", "mail": "[a-z0-9.]+@[a-z0-9.]+", "license": "licensed under"}
    rows = table(spark, sf_dir, "documents")
    found = rows.select(
        "source",
        F.explode(F.map_from_arrays(F.array(*map(F.lit, markers)), F.array(*(F.regexp_count("text", F.lit(p)) for p in markers.values())))).alias("marker", "n")
    )
    return found.groupBy("marker").agg(
        F.sum("n").alias("occurrences"), F.count_if(F.col("n") > 0).alias("documents"),
        F.count_distinct(F.when(F.col("n") > 0, F.col("source"))).alias("sources")
    )


@theme.add(f"SELECT user_id, CAST(sum(least(n, 2)) AS BIGINT) AS capped, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, item, count(*) AS n FROM {EVENTS} GROUP BY 1, 2) GROUP BY 1")
def agg_capped_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts capped per (user, item), then summed per user."""
    per_item = events(spark, sf_dir).groupBy("user_id", "item").count()
    return per_item.groupBy("user_id").agg(F.sum(F.least("count", F.lit(2))).alias("capped"), F.sum("count").alias("n"))


@theme.add("SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS mix FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def agg_histogram_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of types per user, as text."""
    per_type = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    listed = F.array_sort(F.collect_list(F.struct("event_type", "count")))
    return per_type.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["event_type"], F.lit(":"), x["count"].cast("string"))), ",").alias("mix"))


@theme.add(f"SELECT item, round(sum(CASE event_type WHEN 'purchase' THEN 5.0 WHEN 'click' THEN 2.0 WHEN 'view' THEN 1.0 END)::DOUBLE / nullif(count_if(event_type IN ('purchase', 'click', 'view')), 0), 3) AS mean_weight FROM {EVENTS} GROUP BY item")
def agg_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weight over the types that have one; null where an item has none of these."""
    weight = F.create_map(*(F.lit(x) for pair in TYPE_WEIGHTS.items() for x in pair))[F.col("event_type")]
    return events(spark, sf_dir).groupBy("item").agg(F.round(F.try_divide(F.sum(weight), F.count(weight).cast("double")), 3).alias("mean_weight"))


@theme.add("SELECT l_orderkey AS orderkey, round(least(product(1 + l_discount), 1.25), 6) AS boost FROM lineitem GROUP BY 1")
def agg_multiplier_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of multipliers, capped."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.round(F.least(F.product(1 + F.col("l_discount")), F.lit(1.25)), 6).alias("boost"))


@theme.add("""
SELECT facet, value, n FROM (SELECT facet, value, count(*) AS n FROM
  (SELECT unnest(['brand', 'type', 'size']) AS facet, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part WHERE p_retailprice > 1000) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 5""")
def agg_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent values of each facet within a filtered set; all facets in one pass."""
    rows = table(spark, sf_dir, "part").filter("p_retailprice > 1000")
    pairs = rows.select(F.inline(F.array(*(F.struct(F.lit(n).alias("facet"), F.col(c).cast("string").alias("value")) for n, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))))))
    counted = pairs.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counted.withColumn("place", place).filter("place <= 5").select("facet", "value", "n")


@theme.add("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_retailprice > 1000 AND lower(p_brand) LIKE 'brand#1%' GROUP BY 1")
def agg_facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of one facet that begin with a prefix."""
    rows = table(spark, sf_dir, "part").filter(F.col("p_retailprice") > 1000)
    return rows.filter(F.lower("p_brand").startswith("brand#1")).groupBy(F.col("p_brand").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@theme.add(f"SELECT item, count(DISTINCT user_id) AS holders FROM {EVENTS} WHERE event_type = 'purchase' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY item")
def agg_active_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct holders whose holding hasn't lapsed after 14 days."""
    live = F.col("ts") > F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 14 days")
    return events(spark, sf_dir).filter((F.col("event_type") == "purchase") & live).groupBy("item").agg(F.count_distinct("user_id").alias("holders"))


@theme.add("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1")
def agg_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of calendar months over 24 months; months without rows stay out."""
    rows = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1999-01-01' and o_orderdate < timestamp_ntz'2001-01-01'")
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )


@theme.add("SELECT p_brand AS brand, CAST(sum(n) AS BIGINT) AS lines, count(*) AS parts FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1")
def agg_presummed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per tag from counters that are summed before the join."""
    counters = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return counters.join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).groupBy(F.col("p_brand").alias("brand")).agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("parts"))


@theme.add("SELECT role, count(*) AS posts, count_if(turn = 0) AS starts, greatest(0, count(*) - count_if(turn = 0)) AS replies FROM conversations GROUP BY role")
def agg_share_of_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, starts, and replies as their difference, not below zero."""
    rolled = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("turn") == 0).alias("starts"))
    return rolled.withColumn("replies", F.greatest(F.lit(0).cast("long"), F.col("posts") - F.col("starts")))


@theme.add("""
SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority), ())""")
def agg_order_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and revenue by state, by state and priority, and in total."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    sets = [[F.col("status")], [F.col("status"), F.col("priority")], []]
    return rows.groupingSets(sets, "status", "priority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@theme.add("SELECT o_orderpriority AS priority, count(*) AS n, round(100.0 * count_if(o_orderstatus = 'F') / count(*), 2) AS done_rate FROM orders GROUP BY 1")
def agg_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion rate per option."""
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        n.alias("n"), F.round(100.0 * F.count_if(F.col("o_orderstatus") == "F") / n, 2).alias("done_rate")
    )
