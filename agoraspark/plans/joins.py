"""Joins: chains, lookups, self joins, semi and anti joins, as-of and range joins, merges by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.operators.matching import coread_applied, coread_delta, coread_pairs, ladder_lookup, not_in, positional_merge
from agoraspark.plans.base import EVENTS, Theme, events, table
from agoraspark.sources.files import materialised

theme = Theme()
LADDER = [("seed", 0.0), ("sprout", 500000.0), ("branch", 1000000.0), ("oak", 2000000.0)]


@theme.add("""
SELECT s_name, n_name, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts along a chain of inner joins; lines are summed per supplier before the small tables are joined."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    rolled = table(spark, sf_dir, "lineitem").join(done, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")
    )
    named = rolled.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return named.groupBy("s_name", "n_name").agg(F.sum("lines").alias("lines"), F.round(F.sum("quantity"), 2).alias("quantity"))


@theme.add("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def join_left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, null where there is none; the text isn't read."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@theme.add("SELECT c.n_name AS nation, p.n_name AS anchor FROM nation c LEFT JOIN nation p ON p.n_nationkey = c.n_regionkey")
def join_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table joined with itself for the name of a parent key."""
    child, parent = (table(spark, sf_dir, "nation").alias(a) for a in ("c", "p"))
    return child.join(parent, F.col("p.n_nationkey") == F.col("c.n_regionkey"), "left").select(
        F.col("c.n_name").alias("nation"), F.col("p.n_name").alias("anchor")
    )


#: A session is a user's day; user 0 stands for nobody; only purchases count.
VISITS = f"(SELECT CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id END AS uid, (user_id % 10) || '-' || strftime(ts, '%Y-%m-%d') AS session, item, CAST(least(round(value * 100), 10000) AS BIGINT) AS w FROM {EVENTS} WHERE event_type = 'purchase')"


@theme.add(f"""
SELECT x.item AS a, y.item AS b, count(*) AS pairs, CAST(sum(x.w * y.w) AS BIGINT) AS weight FROM {VISITS} x JOIN {VISITS} y
ON ((x.uid = y.uid AND x.uid <> 0) OR x.session = y.session) AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 2""")
def join_coread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items seen together by a user or in a session, with the sum of products of weights."""
    return coread_pairs(_visits(spark, sf_dir), min_pairs=2)


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'purchase'").select(
        F.when(F.col("user_id") % 5 == 0, 0).otherwise(F.col("user_id")).alias("uid"),
        F.concat_ws("-", (F.col("user_id") % 10).cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
        "item",
        F.least(F.round(F.col("value") * 100), F.lit(10000.0)).cast("long").alias("w"),
        "event_id",
        "user_id",
    )


@theme.add(f"""
WITH v AS (SELECT * FROM {VISITS.replace('SELECT CASE', 'SELECT event_id, user_id, CASE', 1)} WHERE NOT (user_id % 16 = 3 AND event_id % 7 = 3))
SELECT x.item AS a, y.item AS b, count(*) AS pairs, CAST(sum(x.w * y.w) AS BIGINT) AS weight FROM v x JOIN v y
ON ((x.uid = y.uid AND x.uid <> 0) OR x.session = y.session) AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 2""")
def join_coread_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of items seen together after some users' visits came and others went, from its state before and signed changes."""
    visits = _visits(spark, sf_dir)
    came, went = (F.col("user_id") % 16 == 3) & (F.col("event_id") % 5 == 2), (F.col("user_id") % 16 == 3) & (F.col("event_id") % 7 == 3)
    before, after, changed = visits.filter(~came), visits.filter(~went), visits.filter(came != went)
    state = materialised(coread_pairs(before, min_pairs=1), "coread")
    return coread_applied(state, coread_delta(before, after, changed)).filter("pairs >= 2")


@theme.add("SELECT o_orderkey AS orderkey, l_partkey AS partkey, l_quantity AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1")
def join_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compound condition with a constant: the first line of each order."""
    first = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    return table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity")
    )


@theme.add(f"SELECT p_partkey AS partkey, max(ts) AS last_seen, count(ts) = 0 AS unread FROM part LEFT JOIN {EVENTS} ON item = p_partkey AND user_id = 7 GROUP BY 1")
def join_left_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose filter is in the condition: marks of one viewer, kept where there are none."""
    mine = events(spark, sf_dir).filter("user_id = 7").groupBy("item").agg(F.max("ts").alias("last_seen"))
    return table(spark, sf_dir, "part").join(mine, F.col("item") == F.col("p_partkey"), "left").select(
        F.col("p_partkey").alias("partkey"), "last_seen", F.col("last_seen").isNull().alias("unread")
    )


@theme.add("SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a partner."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("custkey"))


@theme.add(f"SELECT item, count(*) AS n FROM {EVENTS} WHERE item NOT IN (SELECT item FROM {EVENTS} WHERE user_id = 7) GROUP BY item")
def join_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that one viewer hasn't met; the keys aren't null, so an anti join says the same as NOT IN."""
    rows = events(spark, sf_dir)
    seen = rows.filter("user_id = 7").select("item").distinct()
    return rows.join(seen, "item", "left_anti").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@theme.add(f"""
WITH r AS (SELECT event_id, nullif(item % 10, 3) AS k FROM {EVENTS})
SELECT 'a null among the others' AS kind, event_id FROM r WHERE k NOT IN (SELECT nullif(item % 10, 3) FROM {EVENTS} WHERE event_id % 40 < 20) UNION ALL
SELECT 'no null among them', event_id FROM r WHERE k NOT IN (SELECT item % 10 FROM {EVENTS} WHERE item % 10 IN (1, 5)) UNION ALL
SELECT 'no others', event_id FROM r WHERE k NOT IN (SELECT item % 10 FROM {EVENTS} WHERE item < 0)""")
def join_not_in_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN where keys are null: nothing is left if the others have a null; a null key is left only if there are no others."""
    rows = events(spark, sf_dir).select("event_id", "item", F.nullif(F.col("item") % 10, F.lit(3).cast("long")).alias("k"))
    cases = {
        "a null among the others": rows.filter("event_id % 40 < 20").select("k"),
        "no null among them": rows.filter("item % 10 in (1, 5)").select((F.col("item") % 10).alias("k")),
        "no others": rows.filter("item < 0").select((F.col("item") % 10).alias("k")),
    }
    left = [not_in(rows, others, "k").select(F.lit(kind).alias("kind"), "event_id") for kind, others in cases.items()]
    return left[0].unionAll(left[1]).unionAll(left[2])


@theme.add("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership nested twice."""
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 1")
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@theme.add("SELECT s_suppkey AS suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_returnflag = 'R')")
def join_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a partner of a kind."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_returnflag = 'R'")
    return table(spark, sf_dir, "supplier").join(
        lines, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi"
    ).select(F.col("s_suppkey").alias("suppkey"), "s_name")


@theme.add("SELECT o.o_custkey AS custkey, o.o_orderkey AS orderkey, o.o_totalprice AS price FROM orders o JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) f ON f.o_custkey = o.o_custkey AND f.k = o.o_orderkey")
def join_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each group, as one minimum of a struct."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.min(F.struct("o_orderkey", "o_totalprice")).alias("x"))
    return first.select("custkey", F.col("x.o_orderkey").alias("orderkey"), F.col("x.o_totalprice").alias("price"))


@theme.add("""
SELECT c.conv_id, c.turn, c.role, p.role AS before_role, length(p.text) AS before_chars FROM conversations c
LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id AND m.turn < c.turn)""")
def join_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one before it; a window instead of a join by the greatest smaller turn."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("chars"))
    return rows.select("conv_id", "turn", "role", F.lag("role").over(order).alias("before_role"), F.lag("chars").over(order).alias("before_chars"))


@theme.add("""
WITH a AS (SELECT conv_id // 50 AS thread, row_number() OVER (PARTITION BY conv_id // 50 ORDER BY conv_id, turn) AS i, conv_id, turn FROM conversations WHERE role = 'user'),
     b AS (SELECT conv_id // 50 AS thread, row_number() OVER (PARTITION BY conv_id // 50 ORDER BY conv_id, turn) AS i, conv_id, turn FROM conversations WHERE role = 'assistant'),
     ok AS (SELECT thread FROM (SELECT thread, count(*) AS n FROM a GROUP BY 1) JOIN (SELECT thread, count(*) AS n FROM b GROUP BY 1) USING (thread, n))
SELECT thread, i AS place, a.conv_id AS left_conv, a.turn AS left_turn, b.conv_id AS right_conv, b.turn AS right_turn FROM a JOIN b USING (thread, i) JOIN ok USING (thread)""")
def join_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences of a thread merged place by place, only where they are equally long."""
    rows = table(spark, sf_dir, "conversations").withColumn("thread", F.floor(F.col("conv_id") / 50))
    sides = [rows.filter(F.col("role") == role).select("thread", F.struct("conv_id", "turn").alias("row")) for role in ("user", "assistant")]
    merged = positional_merge(*sides, key="thread", row="row")
    return merged.select(
        "thread", "place", F.col("left.conv_id").alias("left_conv"), F.col("left.turn").alias("left_turn"),
        F.col("right.conv_id").alias("right_conv"), F.col("right.turn").alias("right_turn")
    )


@theme.add("""
WITH spent AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS points FROM orders GROUP BY 1)
SELECT o_custkey AS custkey, CAST(points AS DOUBLE) AS points, CASE WHEN points >= 2000000 THEN 'oak' WHEN points >= 1000000 THEN 'branch' WHEN points >= 500000 THEN 'sprout' ELSE 'seed' END AS rung,
       CASE WHEN points >= 2000000 THEN NULL WHEN points >= 1000000 THEN 2000000.0 WHEN points >= 500000 THEN 1000000.0 ELSE 500000.0 END::DOUBLE AS next_at FROM spent""")
def join_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest rung whose threshold is reached, and the next one."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100).alias("points"))
    return ladder_lookup(spent, "points", LADDER)


@theme.add(f"""
SELECT user_id, max(rank) AS rank, max(until_ts) FILTER (WHERE rank = top) AS until_ts
FROM (SELECT user_id, rank, until_ts, max(rank) OVER (PARTITION BY user_id) AS top FROM
  (SELECT user_id, CAST(item % 4 AS BIGINT) AS rank, ts + INTERVAL 10 DAY AS until_ts FROM {EVENTS} WHERE event_type = 'purchase') WHERE until_ts > TIMESTAMP '2024-01-31') GROUP BY user_id""")
def join_active_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rank among intervals that hold at a time, with its latest end."""
    held = events(spark, sf_dir).filter("event_type = 'purchase'").select(
        "user_id", (F.col("item") % 4).alias("rank"), (F.col("ts") + F.expr("interval 10 days")).alias("until_ts")
    )
    best = held.filter("until_ts > timestamp_ntz'2024-01-31'").groupBy("user_id").agg(F.max(F.struct("rank", "until_ts")).alias("x"))
    return best.select("user_id", "x.rank", "x.until_ts")


@theme.add("SELECT p_partkey AS partkey, p_retailprice + 0.0 AS price, coalesce(n, 0) AS sold, round(coalesce(r, 0), 2) AS revenue FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_extendedprice) AS r FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def join_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's new state after an update from an aggregate of another."""
    rolled = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("r"))
    rows = table(spark, sf_dir, "part").join(rolled, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select(
        F.col("p_partkey").alias("partkey"), F.col("p_retailprice").alias("price"),
        F.coalesce("n", F.lit(0).cast("long")).alias("sold"), F.round(F.coalesce("r", F.lit(0.0)), 2).alias("revenue")
    )


@theme.add("""
SELECT custkey, kind, score FROM (
  SELECT c_custkey AS custkey, 'account' AS kind, round(c_acctbal * 1.4, 4) AS score FROM customer WHERE c_acctbal > 5000
  UNION ALL SELECT o_custkey, 'order', round(max(o_totalprice) / 100.0, 4) FROM orders GROUP BY 1 HAVING max(o_totalprice) > 400000)
QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY score DESC, kind) = 1""")
def join_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weighted result lists merged; the better entry of each key stays."""
    accounts = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(
        F.col("c_custkey").alias("custkey"), F.lit("account").alias("kind"), F.round(F.col("c_acctbal") * 1.4, 4).alias("score")
    )
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_totalprice").alias("most")).filter("most > 400000")
    merged = accounts.unionByName(best.select("custkey", F.lit("order").alias("kind"), F.round(F.col("most") / 100.0, 4).alias("score")))
    kept = merged.groupBy("custkey").agg(F.min(F.struct((-F.col("score")).alias("less"), "kind", "score")).alias("x"))
    return kept.select("custkey", "x.kind", "x.score")
