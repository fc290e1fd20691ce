"""Window-like queries: gaps, streaks, caps, top rows per group, and sort orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.operators.sequences import accepted_rows, diversified, streaks
from agoraspark.plans.base import EVENTS, Theme, events, table

theme = Theme()


@theme.add("""
SELECT orderkey, custkey, gap_days FROM (SELECT o_orderkey AS orderkey, o_custkey AS custkey, CAST(date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS BIGINT) AS gap_days FROM orders)
WHERE gap_days >= 180""")
def win_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that follow the customer's previous one after 180 days or more."""
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"),
        F.date_diff("o_orderdate", before).cast("long").alias("gap_days")
    )
    return rows.filter("gap_days >= 180")


ISLANDS = """(SELECT user_id, min(day) AS start, max(day) AS stop, count(*) AS length FROM
  (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view')) GROUP BY user_id, island)"""


@theme.add(f"SELECT user_id, start, stop, length FROM {ISLANDS}")
def win_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive days with a view."""
    return streaks(table(spark, sf_dir, "events").filter("event_type = 'view'"), "user_id", "ts")


@theme.add(f"SELECT user_id, max(length) AS best, max(CASE WHEN stop >= DATE '2024-01-29' THEN length ELSE 0 END) AS running, CAST(sum(length) AS BIGINT) AS days FROM {ISLANDS} GROUP BY user_id")
def win_streak_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and running streak per user, recomputed from the days that are there."""
    runs = streaks(table(spark, sf_dir, "events").filter("event_type = 'view'"), "user_id", "ts")
    running = F.max(F.when(F.col("stop") >= F.lit("2024-01-29").cast("date"), F.col("length")).otherwise(0))
    return runs.groupBy("user_id").agg(F.max("length").alias("best"), running.cast("long").alias("running"), F.sum("length").alias("days"))


@theme.add("""
WITH RECURSIVE d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')),
f AS (SELECT user_id, day, i, 1::BIGINT AS run, 2::BIGINT AS freezes FROM d WHERE i = 1 UNION ALL
  SELECT d.user_id, d.day, d.i, CASE WHEN d.day - f.day = 1 OR (d.day - f.day = 2 AND f.freezes > 0) THEN f.run + 1 ELSE 1 END, CASE WHEN d.day - f.day = 2 AND f.freezes > 0 THEN f.freezes - 1 ELSE f.freezes END
  FROM f JOIN d ON d.user_id = f.user_id AND d.i = f.i + 1)
SELECT user_id, max(run) AS best, min(freezes) AS freezes_left FROM f GROUP BY user_id""")
def win_streak_freezes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best streak per user where two gaps of one missed day are bridged: a fold over the user's distinct days."""
    days = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    listed = days.groupBy("user_id").agg(F.array_sort(F.collect_list("day")).alias("days"))

    def step(s, day):
        gap = F.date_diff(day, s["last"])
        frozen = (gap == 2) & (s["freezes"] > 0)
        run = F.when((gap == 1) | frozen, s["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(
            day.alias("last"), run.alias("run"), F.when(frozen, s["freezes"] - 1).otherwise(s["freezes"]).alias("freezes"),
            F.greatest(s["best"], run).alias("best")
        )

    start = F.struct(
        F.get("days", F.lit(0)).alias("last"), F.lit(1).cast("long").alias("run"), F.lit(2).cast("long").alias("freezes"),
        F.lit(1).cast("long").alias("best")
    )
    end = F.aggregate(F.slice("days", 2, F.greatest(F.size("days") - 1, F.lit(0))), start, step)
    return listed.withColumn("end", end).select("user_id", "end.best", F.col("end.freezes").alias("freezes_left"))


@theme.add("""
SELECT user_id, day, i AS active_days FROM (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)) WHERE i % 7 = 0""")
def win_every_seventh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh active day of a user."""
    days = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    placed = days.withColumn("active_days", F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("long"))
    return placed.filter("active_days % 7 = 0")


@theme.add(f"""
WITH r AS (SELECT item % 10 AS grp, item % 3 AS tag, item, count(*) AS n FROM {EVENTS} GROUP BY 1, 2, 3),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp, tag ORDER BY n DESC, item) > 2 AS INTEGER) AS spill FROM r)
SELECT grp, tag, item, n, place FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY spill, n DESC, item) AS place FROM s) WHERE place <= 7""")
def win_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best seven items of each group, two per tag before the rest fills up."""
    counted = events(spark, sf_dir).groupBy((F.col("item") % 10).alias("grp"), (F.col("item") % 3).alias("tag"), "item").agg(F.count(F.lit(1)).alias("n"))
    return diversified(counted, "grp", [F.desc("n"), F.col("item")], "tag", 7, 2).withColumn("place", F.col("place").cast("long"))


@theme.add("SELECT o_custkey AS custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey) AS dearest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i <= 3 GROUP BY 1")
def win_first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three per key as a list."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    first = table(spark, sf_dir, "orders").withColumn("place", place).filter("place <= 3")
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("o_orderkey").cast("string").alias("k"))))
    return first.groupBy(F.col("o_custkey").alias("custkey")).agg(F.array_join(F.transform(listed, lambda x: x["k"]), ",").alias("dearest"))


@theme.add(f"SELECT user_id, item, event_id, ts FROM {EVENTS} WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) = 1")
def win_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without repeats of a key; the earliest stays."""
    rows = events(spark, sf_dir).filter("event_type = 'view'")
    return rows.groupBy("user_id", "item").agg(F.min(F.struct("ts", "event_id")).alias("x")).select("user_id", "item", "x.event_id", "x.ts")


def _seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seconds", F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")))


CHAIN = """
WITH RECURSIVE e AS (SELECT user_id, event_id, date_sub('second', TIMESTAMP '2024-01-01', ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY date_sub('second', TIMESTAMP '2024-01-01', ts), event_id) AS i FROM events WHERE event_type = 'view'),
"""


@theme.add(f"""{CHAIN}f AS (SELECT user_id, event_id, i, s AS last, true AS accepted FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.i, CASE WHEN e.s - f.last >= 7200 THEN e.s ELSE f.last END, e.s - f.last >= 7200 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, accepted FROM f""")
def win_anchored_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user count if the last one that counted is two hours old or older."""
    rows = _seconds(table(spark, sf_dir, "events").filter("event_type = 'view'").select("user_id", "event_id", "ts")).drop("ts")
    return accepted_rows(rows, ["user_id"], "seconds", "event_id", gap=7200).select("user_id", "event_id", "accepted")


@theme.add(f"""{CHAIN}f AS (SELECT user_id, event_id, i, [s] AS kept, true AS accepted FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.i, CASE WHEN len(list_filter(f.kept, lambda k: e.s - k < 432000)) < 3 THEN list_append(f.kept, e.s) ELSE f.kept END, len(list_filter(f.kept, lambda k: e.s - k < 432000)) < 3
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, accepted FROM f""")
def win_rolling_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows per user in any five days count; what is turned away doesn't use the cap up."""
    rows = _seconds(table(spark, sf_dir, "events").filter("event_type = 'view'").select("user_id", "event_id", "ts")).drop("ts")
    return accepted_rows(rows, ["user_id"], "seconds", "event_id", cap=3, span=432000).select("user_id", "event_id", "accepted")


@theme.add("""
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY date_sub('second', TIMESTAMP '2024-01-01', ts) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n_24h
FROM events WHERE event_type = 'click'""")
def win_rolling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clicks of the user lie within the 24 hours up to each."""
    rows = _seconds(table(spark, sf_dir, "events").filter("event_type = 'click'"))
    return rows.select("event_id", "user_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("seconds").rangeBetween(-86399, 0)).alias("n_24h"))


@theme.add(f"SELECT user_id, item, n, round(n / max(n) OVER (PARTITION BY user_id), 6) AS affinity FROM (SELECT user_id, item, count(*) AS n FROM {EVENTS} WHERE event_type = 'view' GROUP BY 1, 2)")
def win_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts divided by the user's greatest one."""
    counted = events(spark, sf_dir).filter("event_type = 'view'").groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", "item", "n", F.round(F.col("n") / F.max("n").over(Window.partitionBy("user_id")), 6).alias("affinity"))


@theme.add("""
SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_shipmode FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'new' END AS l_shipmode,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber) AS i FROM lineitem) WHERE i = 1""")
def win_best_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per order by priority of its flag, ties by number."""
    flag = F.col("l_returnflag")
    priority = F.when(flag == "R", 0).when(flag == "A", 1).otherwise(2)
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.min(F.struct(priority.alias("p"), "l_linenumber")).alias("x"))
    return best.select(
        "orderkey", F.col("x.l_linenumber").alias("linenumber"),
        F.when(F.col("x.p") == 0, "returned").when(F.col("x.p") == 1, "accepted").otherwise("new").alias("l_shipmode")
    )


@theme.add("SELECT o_custkey AS custkey, CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END) WHEN 4 THEN 'urgent' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS worst FROM orders GROUP BY 1")
def win_worst_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of ordered levels."""
    levels = ["low", "medium", "high", "urgent"]
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 4).when(F.col("o_orderpriority") == "2-HIGH", 3).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(1)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.element_at(F.array(*map(F.lit, levels)), F.max(level)).alias("worst"))


@theme.add("SELECT p_partkey AS partkey, slug || CASE WHEN i > 1 THEN '-' || i ELSE '' END AS slug FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS i FROM (SELECT p_partkey, lower(replace(p_brand || '-' || p_size, '#', '')) AS slug FROM part))")
def win_numbered_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs made unique by a number from the second on."""
    slug = F.lower(F.regexp_replace(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")), "#", ""))
    placed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), slug.alias("slug")).withColumn(
        "i", F.row_number().over(Window.partitionBy("slug").orderBy("partkey"))
    )
    return placed.select("partkey", F.concat("slug", F.when(F.col("i") > 1, F.concat(F.lit("-"), F.col("i").cast("string"))).otherwise("")).alias("slug"))


@theme.add("SELECT o_orderkey AS orderkey, round(log10(1 + o_totalprice) * 2 + CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END, 6) AS score FROM orders ORDER BY log10(1 + o_totalprice) * 2 + CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END DESC, o_orderkey LIMIT 50")
def sort_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best by a log-weighted expression, ties by key; each task keeps fifty."""
    score = F.log10(1 + F.col("o_totalprice")) * 2 + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), score.alias("raw"))
    return rows.orderBy(F.desc("raw"), "orderkey").limit(50).select("orderkey", F.round("raw", 6).alias("score"))


@theme.add("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality IS NULL, quality DESC, doc_id LIMIT 40 OFFSET 20")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of rows, those without value last."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(F.desc_nulls_last("quality"), "doc_id").offset(20).limit(40)


@theme.add("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def sort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays if each user keeps the newest five."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf_dir, "events").select("event_id", "user_id").withColumn("place", place).filter("place <= 5").drop("place")
