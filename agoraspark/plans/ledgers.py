"""Ledgers, awards, orders as state machines, reconciliation and invariants. Amounts are in hundredths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.operators.ledger import balances, changes, drift, guarded, idempotent
from agoraspark.operators.matching import ladder_lookup
from agoraspark.plans.base import AS_OF, EVENTS, Theme, events, table

theme = Theme()
CENTS = "CAST(round(value * 100) AS BIGINT)"
DELTA = f"CASE event_type WHEN 'purchase' THEN {CENTS} WHEN 'click' THEN {CENTS} WHEN 'error' THEN -{CENTS} ELSE 0 END"
RUNGS = [("stone", 0.0), ("copper", 50000.0), ("silver", 100000.0), ("gold", 150000.0)]
RUNG_SQL = "CASE WHEN {0} >= 150000 THEN 'gold' WHEN {0} >= 100000 THEN 'silver' WHEN {0} >= 50000 THEN 'copper' WHEN {0} >= 0 THEN 'stone' END"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "item", F.expr(DELTA).alias("delta"))


@theme.add(f"SELECT user_id, event_type, item, event_id, {DELTA} AS delta FROM {EVENTS} QUALIFY row_number() OVER (PARTITION BY user_id, event_type, item ORDER BY event_id) = 1")
def led_idempotent_award(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per user, reason and reference; later ones are ignored."""
    kept = idempotent(_entries(spark, sf_dir), ["user_id", "event_type", "item"], ["event_id"])
    return kept.select("user_id", "event_type", "item", "event_id", "delta")


@theme.add("""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) ELSE -CAST(round(value * 100) AS BIGINT) END AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
  FROM events WHERE event_type IN ('click', 'purchase')),
f AS (SELECT user_id, event_id, i, d >= 0 AS granted, greatest(d, 0) AS balance FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.i, e.d >= 0 OR f.balance + e.d >= 0, CASE WHEN e.d >= 0 OR f.balance + e.d >= 0 THEN f.balance + e.d ELSE f.balance END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, granted, balance FROM f""")
def led_guarded_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending is granted only as far as the balance of what was granted before covers it."""
    cents = F.expr(CENTS)
    rows = events(spark, sf_dir).filter("event_type in ('click', 'purchase')").select(
        "user_id", "event_id", F.when(F.col("event_type") == "click", cents).otherwise(-cents).alias("delta")
    )
    return guarded(rows, "user_id", "delta", ["event_id"]).select("user_id", "event_id", "granted", "balance")


@theme.add(f"SELECT user_id, CAST(sum({DELTA}) AS BIGINT) AS balance, CAST(sum(CASE WHEN event_type <> 'click' THEN greatest({DELTA}, 0) ELSE 0 END) AS BIGINT) AS lifetime FROM events GROUP BY user_id")
def led_credit_not_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances where one kind of credit doesn't count towards the lifetime sum."""
    return balances(_entries(spark, sf_dir), "user_id", "delta", F.col("event_type") != "click")


@theme.add(f"""
SELECT user_id, CAST(sum(d) FILTER (WHERE item % 10 <> 3) AS BIGINT) AS balance, greatest(CAST(sum(greatest(d, 0)) AS BIGINT) - CAST(coalesce(sum(abs(d)) FILTER (WHERE item % 10 = 3), 0) AS BIGINT), 0) AS lifetime
FROM (SELECT *, {DELTA} AS d FROM {EVENTS}) GROUP BY user_id""")
def led_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of some references are taken back; the lifetime sum isn't pushed below zero."""
    revoked = F.col("item") % 10 == 3
    rolled = _entries(spark, sf_dir).groupBy("user_id").agg(
        F.sum(F.when(~revoked, F.col("delta"))).alias("balance"), F.sum(F.greatest("delta", F.lit(0))).alias("earned"),
        F.sum(F.when(revoked, F.abs("delta")).otherwise(0)).alias("taken")
    )
    return rolled.select("user_id", "balance", F.greatest(F.col("earned") - F.col("taken"), F.lit(0)).alias("lifetime"))


@theme.add("SELECT c_custkey AS custkey, CAST(coalesce(sum(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END * CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS balance FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def led_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of all customers from the ledger, 0 without entries."""
    sign = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)
    entries = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), (sign * F.round(F.col("o_totalprice") * 100).cast("long")).alias("delta")
    )
    known = balances(entries, "custkey", "delta").select("custkey", "balance")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).join(known, "custkey", "left").select(
        "custkey", F.coalesce("balance", F.lit(0).cast("long")).alias("balance")
    )


@theme.add(f"""
SELECT event_id, user_id, CAST(floor(c * (CASE WHEN user_id % 3 = 0 THEN 1.5 ELSE 1.0 END) * least(CASE WHEN item % 2 = 0 THEN 1.25 ELSE 1.0 END * CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 2.0 ELSE 1.0 END, 2.0)) AS BIGINT) AS award
FROM (SELECT *, {CENTS} AS c FROM {EVENTS} WHERE event_type = 'purchase')""")
def led_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards by tier, boosts that are capped together, and an early window."""
    tier = F.when(F.col("user_id") % 3 == 0, 1.5).otherwise(1.0)
    boost = F.when(F.col("item") % 2 == 0, 1.25).otherwise(1.0) * F.when(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"), 2.0).otherwise(1.0)
    rows = events(spark, sf_dir).filter("event_type = 'purchase'")
    return rows.select("event_id", "user_id", F.floor(F.expr(CENTS) * tier * F.least(boost, F.lit(2.0))).cast("long").alias("award"))


@theme.add("""
SELECT user_id, count_if(CAST(ts AS DATE) = DATE '2024-01-29') AS today, count(*) AS this_week, count_if(CAST(ts AS DATE) = DATE '2024-01-29') >= 2 AS day_done, count(*) >= 5 AS week_done
FROM events WHERE event_type = 'view' AND date_trunc('week', ts) = date_trunc('week', TIMESTAMP '2024-01-29') GROUP BY user_id""")
def led_quests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a day and of an ISO week against targets."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'view' and ts >= timestamp_ntz'2024-01-29' and ts < timestamp_ntz'2024-02-05'")
    today = F.count_if(F.col("ts").cast("date") == F.lit("2024-01-29").cast("date"))
    return rows.groupBy("user_id").agg(today.alias("today"), F.count(F.lit(1)).alias("this_week")).withColumns({"day_done": F.col("today") >= 2, "week_done": F.col("this_week") >= 5})


@theme.add(f"""
WITH s AS (SELECT user_id, event_id, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM (SELECT user_id, event_id, {CENTS} AS d FROM events WHERE event_type = 'purchase'))
SELECT user_id, {RUNG_SQL.format("total")} AS rung, min(event_id) AS reached_by FROM s GROUP BY 1, 2""")
def led_rung_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry by which each user reached each rung, once per rung."""
    rows = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "event_id", F.expr(CENTS).alias("delta"))
    running = rows.withColumn("total", F.sum("delta").over(Window.partitionBy("user_id").orderBy("event_id")))
    return ladder_lookup(running, "total", RUNGS).groupBy("user_id", "rung").agg(F.min("event_id").alias("reached_by"))


@theme.add(f"""
WITH m AS (SELECT user_id, count(*) AS posts, count(DISTINCT item) AS items, count_if(event_type = 'purchase') AS buys, count_if(event_type = 'purchase') / greatest(count_if(event_type = 'view'), 1) AS ratio FROM {EVENTS} GROUP BY 1)
SELECT user_id, badge FROM (SELECT user_id, unnest([CASE WHEN posts >= 60 THEN 'busy' END, CASE WHEN items >= 40 THEN 'broad' END, CASE WHEN buys >= 12 THEN 'buyer' END, CASE WHEN ratio >= 1 AND buys >= 5 THEN 'keen' END]) AS badge FROM m)
WHERE badge IS NOT NULL AND (user_id, badge) NOT IN (SELECT DISTINCT user_id, 'busy' FROM events WHERE user_id % 4 = 0)""")
def led_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badges by thresholds over several measures, without those held already."""
    rows = events(spark, sf_dir)
    kind = lambda k: F.count_if(F.col("event_type") == k)
    m = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("posts"), F.count_distinct("item").alias("items"), kind("purchase").alias("buys"),
        (kind("purchase") / F.greatest(kind("view"), F.lit(1))).alias("ratio")
    )
    rules = {"busy": F.col("posts") >= 60, "broad": F.col("items") >= 40, "buyer": F.col("buys") >= 12, "keen": (F.col("ratio") >= 1) & (F.col("buys") >= 5)}
    earned = m.select("user_id", F.explode(F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))).alias("badge"))
    held = rows.filter("user_id % 4 = 0").select("user_id", F.lit("busy").alias("badge")).distinct()
    return earned.join(held, ["user_id", "badge"], "left_anti")


@theme.add(f"SELECT user_id, count_if(value >= 85) AS deep, count(DISTINCT CASE WHEN value >= 85 THEN item END) AS deep_items FROM {EVENTS} WHERE event_type = 'view' GROUP BY 1 HAVING count_if(value >= 85) > 0")
def led_deep_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose views reach a depth, with how many and of how many items."""
    deep = F.col("value") >= 85
    rolled = events(spark, sf_dir).filter("event_type = 'view'").groupBy("user_id").agg(
        F.count_if(deep).alias("deep"), F.count_distinct(F.when(deep, F.col("item"))).alias("deep_items")
    )
    return rolled.filter("deep > 0")


@theme.add("""
SELECT user_id, item, CASE WHEN list_contains(states, 'error') AND list_contains(states, 'purchase') THEN 'refunded' WHEN list_contains(states, 'purchase') THEN 'granted' WHEN list_contains(states, 'error') THEN 'failed' WHEN list_contains(states, 'click') THEN 'pending' ELSE 'new' END AS state,
       len(states) AS steps FROM (SELECT user_id, item, list(event_type ORDER BY ts, event_id) AS states FROM (SELECT * FROM """ + EVENTS + """) GROUP BY 1, 2)""")
def led_order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each order from the set of transitions that happened."""
    has = lambda k: F.count_if(F.col("event_type") == k) > 0
    state = F.when(has("error") & has("purchase"), "refunded").when(has("purchase"), "granted").when(has("error"), "failed").when(has("click"), "pending").otherwise("new")
    return events(spark, sf_dir).groupBy("user_id", "item").agg(state.alias("state"), F.count(F.lit(1)).alias("steps"))


@theme.add("""
SELECT orderkey, problem FROM (
  SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = 'F' AND coalesce(n, 0) = 0 THEN 'paid, nothing granted' WHEN o_orderstatus = 'O' AND coalesce(n, 0) > 5 THEN 'granted, not paid'
    WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2000-01-01' THEN 'stuck' END AS problem
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) WHERE problem IS NOT NULL""")
def led_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose state and lines disagree, by kind of problem."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stuck = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    problem = F.when(
        (F.col("o_orderstatus") == "F") & (F.col("n") == 0), "paid, nothing granted"
    ).when((F.col("o_orderstatus") == "O") & (F.col("n") > 5), "granted, not paid").when(stuck, "stuck")
    return rows.select(F.col("o_orderkey").alias("orderkey"), problem.alias("problem")).filter("problem is not null")


@theme.add("""
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(s, 0) AS stored, coalesce(n, 0) AS actual FROM (SELECT user_id, count(*) AS s FROM events WHERE event_id % 50 <> 0 AND event_type = 'purchase' GROUP BY 1) a
FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.user_id = b.user_id WHERE coalesce(s, 0) <> coalesce(n, 0)""")
def led_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that miss some entries against the recomputed ones."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    count = lambda r: r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return drift(count(rows.filter("event_id % 50 <> 0")), count(rows), "user_id", "n")


@theme.add("""
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-05') a FULL JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-25') b ON a.user_id = b.user_id""")
def led_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members added, removed and kept between two states."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return changes(rows.filter("ts < timestamp_ntz'2024-01-05'"), rows.filter("ts >= timestamp_ntz'2024-01-25'"), ["user_id"])


@theme.add("""
SELECT p_partkey AS partkey, CASE WHEN p_size > 40 THEN 'too large' WHEN p_retailprice > 1500 THEN 'too dear' WHEN coalesce(n, 0) >= 30 THEN 'sold out' ELSE 'open' END AS reason, CAST(floor(CAST(round(p_retailprice * 100) AS BIGINT) * 0.85) AS BIGINT) AS price
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def led_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of ordered reasons against a purchase, and the price after a discount, rounded down."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    reason = F.when(F.col("p_size") > 40, "too large").when(F.col("p_retailprice") > 1500, "too dear").when(F.coalesce("n", F.lit(0)) >= 30, "sold out").otherwise("open")
    # hundredths times per cent stays whole until the division
    price = F.floor(F.round(F.col("p_retailprice") * 100).cast("long") * 85 / 100)
    return rows.select(F.col("p_partkey").alias("partkey"), reason.alias("reason"), price.cast("long").alias("price"))


@theme.add("""
SELECT invariant, violations FROM (
  SELECT 'line without order' AS invariant, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS violations UNION ALL
  SELECT 'order without customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL
  SELECT 'order key twice', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) UNION ALL
  SELECT 'discount out of range', (SELECT count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 1))""")
def led_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows that break an invariant."""
    lines, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    checks = {
        "line without order": lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "order without customer": orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "order key twice": orders.groupBy("o_orderkey").count().filter("count > 1"),
        "discount out of range": lines.filter("not l_discount between 0 and 1"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("invariant"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


@theme.add("""
SELECT c.conv_id, count(*) FILTER (WHERE c.turn > coalesce(m.last_read, -1) AND c.role <> 'user') AS unread
FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) AS last_read FROM conversations WHERE role = 'user' GROUP BY 1) m USING (conv_id) GROUP BY 1""")
def led_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of others after one's own last one, by one pass over each conversation."""
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("last_read", F.coalesce(last, F.lit(-1)))
    return rows.groupBy("conv_id").agg(F.count_if((F.col("turn") > F.col("last_read")) & (F.col("role") != "user")).alias("unread"))


@theme.add(f"SELECT user_id, item, max(ts) AS started_at, max(ts) + INTERVAL 7 DAY <= TIMESTAMP '{AS_OF}' AS expired FROM {EVENTS} WHERE event_type = 'signup' GROUP BY 1, 2")
def led_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which holdings have run out at a time; the latest start counts."""
    held = events(spark, sf_dir).filter("event_type = 'signup'").groupBy("user_id", "item").agg(F.max("ts").alias("started_at"))
    return held.withColumn("expired", F.col("started_at") + F.expr("interval 7 days") <= F.lit(AS_OF).cast("timestamp_ntz"))


@theme.add("""
SELECT o_orderkey AS orderkey, CASE WHEN h < 60 THEN 'common' WHEN h < 90 THEN 'rare' ELSE 'epic' END AS drawn
FROM (SELECT o_orderkey, CAST(('0x' || substr(md5('draw-' || o_orderkey), 1, 7)) AS BIGINT) % 100 AS h FROM orders)""")
def led_weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw by weights 60, 30 and 10 that a seed and the key decide, so that it can be repeated."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("draw-"), F.col("o_orderkey").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long") % 100
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.when(h < 60, "common").when(h < 90, "rare").otherwise("epic").alias("drawn")
    )
