"""Awards, measures and states of orders; queues with markers and dead letters; scans that go on; sinks that are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.operators.ledger import idempotent
from agoraspark.operators.sequences import accepted_rows, streaks
from agoraspark.plans.base import AS_OF, EVENTS, Theme, events, table
from agoraspark.sources.files import after, exported, id_ranges, json_batches, materialised, read_events_json, read_json_document, rebuilt, shards, shared_path
from agoraspark.streaming.state import applied, expanded, retry_at

theme = Theme()

# Fixed values of this ledger: points by reason; a reason without points awards nothing.
POINTS = {"purchase": 10, "click": 3, "view": 1, "signup": 0}
BASE = "CASE event_type WHEN 'purchase' THEN 10 WHEN 'click' THEN 3 WHEN 'view' THEN 1 END"


@theme.add(f"""
WITH RECURSIVE a AS (SELECT event_id, user_id, event_type AS reason, item AS ref, date_sub('second', TIMESTAMP '2024-01-01', ts) AS s, CAST(round_even({BASE} * (CASE WHEN item % 4 = 0 THEN 0.04 WHEN item % 4 = 1 THEN 2.0 ELSE 1.0 END) * (CASE WHEN user_id % 3 = 0 THEN 1.5 ELSE 1.0 END), 0) AS BIGINT) AS delta FROM {EVENTS} WHERE event_type IN ('purchase', 'click', 'view')),
u AS (SELECT * FROM a WHERE delta <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, reason, ref ORDER BY event_id) = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, reason ORDER BY s, event_id) AS i FROM u),
f AS (SELECT event_id, user_id, reason, ref, delta, i, [s] AS kept, true AS paid FROM e WHERE i = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.reason, e.ref, e.delta, e.i, CASE WHEN len(list_filter(f.kept, lambda k: e.s - k < 172800)) < 2 THEN list_append(f.kept, e.s) ELSE f.kept END, len(list_filter(f.kept, lambda k: e.s - k < 172800)) < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.reason = f.reason AND e.i = f.i + 1)
SELECT event_id, user_id, reason, ref, delta FROM f WHERE paid""")
def led_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards by reason, multiplier and tier, rounded; none of zero, one per user, reason and reference, two of a reason in two days."""
    points = F.element_at(F.create_map(*(F.lit(x) for pair in POINTS.items() for x in pair)), F.col("event_type"))
    times = F.when(F.col("item") % 4 == 0, 0.04).when(F.col("item") % 4 == 1, 2.0).otherwise(1.0) * F.when(F.col("user_id") % 3 == 0, 1.5).otherwise(1.0)
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    rows = events(spark, sf_dir).filter(F.col("event_type").isin(list(POINTS))).select(
        "event_id", "user_id", F.col("event_type").alias("reason"), F.col("item").alias("ref"), seconds.alias("seconds"),
        F.bround(points * times).cast("long").alias("delta")
    )
    once = idempotent(rows.filter("delta <> 0"), ["user_id", "reason", "ref"], ["event_id"])
    return accepted_rows(
        once, ["user_id", "reason"], "seconds", "event_id", cap=2, span=172800
    ).filter("accepted").select("event_id", "user_id", "reason", "ref", "delta")


@theme.add(f"""
WITH w AS (SELECT user_id, isoyear(ts) AS y, week(ts) AS w, count(*) AS done FROM events WHERE event_type = 'view' GROUP BY 1, 2, 3), c AS (SELECT DISTINCT user_id, 'week:' || isoyear(ts) || '-' || lpad(week(ts)::VARCHAR, 2, '0') AS ref FROM events WHERE event_type = 'signup' AND event_id % 3 = 0)
SELECT w.user_id, 'week:' || y || '-' || lpad(w::VARCHAR, 2, '0') AS ref, done, done >= 4 AS complete, c.ref IS NOT NULL AS claimed, done >= 4 AND c.ref IS NULL AS due FROM w LEFT JOIN c ON c.user_id = w.user_id AND c.ref = 'week:' || y || '-' || lpad(w::VARCHAR, 2, '0')""")
def led_quest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly counts against a target, with what was claimed already by the week's reference."""
    ref = F.concat(
        F.lit("week:"), F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("-"),
        F.lpad(F.weekofyear("ts").cast("string"), 2, "0")
    ).alias("ref")
    rows = table(spark, sf_dir, "events")
    done = rows.filter("event_type = 'view'").groupBy("user_id", ref).agg(F.count(F.lit(1)).alias("done"))
    claims = rows.filter("event_type = 'signup' and event_id % 3 = 0").select("user_id", ref, F.lit(True).alias("claim")).distinct()
    both = done.join(claims, ["user_id", "ref"], "left").withColumns({"complete": F.col("done") >= 4, "claimed": F.col("claim").isNotNull()})
    return both.select("user_id", "ref", "done", "complete", "claimed", (F.col("complete") & ~F.col("claimed")).alias("due"))


MEASURES_SQL = f"""SELECT user_id, count_if(event_type IN ('click', 'view')) AS posts, count(DISTINCT CASE WHEN event_type = 'purchase' THEN item END) AS threads, count_if(event_type = 'signup' AND value >= 60) AS guides, count_if(event_type = 'signup' AND item % 2 = 0) AS sourced,
  count_if(event_type = 'click') AS reactions, CASE WHEN count_if(event_type IN ('click', 'view')) >= 20 THEN CAST(floor(10 * count_if(event_type = 'click') / greatest(count_if(event_type IN ('click', 'view')), 1)) AS BIGINT) ELSE 0 END AS ratio,
  count(DISTINCT CASE WHEN event_type = 'view' AND value >= 85 THEN item * 100 + event_id % 100 END) AS readthrough, CAST(floor(sum(CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) / 100) AS BIGINT) AS dwell, date_diff('day', min(ts), TIMESTAMP '{AS_OF}') AS tenure,
  count_if(hour(ts) BETWEEN 2 AND 4) AS nightowl, count(DISTINCT CASE WHEN ts > TIMESTAMP '2024-01-20' AND item < 10 THEN item END) AS necro, count_if(ts < TIMESTAMP '2024-01-03') AS imported, CAST(max(CASE WHEN event_type = 'error' THEN item ELSE 0 END) AS BIGINT) AS legacy, max(CASE WHEN item = 42 THEN 1 ELSE 0 END)::BIGINT AS banner FROM {EVENTS} GROUP BY 1"""
BADGES = {
    "posts": 15, "threads": 12, "guides": 5, "sourced": 8, "reactions": 15, "ratio": 6, "readthrough": 3, "dwell": 700,
    "tenure": 30, "nightowl": 12, "necro": 3, "imported": 4, "legacy": 95, "banner": 1
}


@theme.add(f"SELECT user_id, measure, CAST(n AS BIGINT) AS n FROM (UNPIVOT ({MEASURES_SQL}) ON COLUMNS(* EXCLUDE (user_id)) INTO NAME measure VALUE n) JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in BADGES.items())}) AS b(measure, least) USING (measure) WHERE n >= least")
def led_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen measures of each user in one wide aggregate, and the badges whose thresholds they reach."""
    kind = lambda *k: F.col("event_type").isin(*k)
    count = lambda c: F.count_if(c)
    item, ts, value = F.col("item"), F.col("ts"), F.col("value")
    posts, clicks = count(kind("click", "view")), count(kind("click"))
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    m = {
        "posts": posts,
        "threads": F.count_distinct(F.when(kind("purchase"), item)),
        "guides": count(kind("signup") & (value >= 60)),
        "sourced": count(kind("signup") & (item % 2 == 0)),
        "reactions": clicks,
        "ratio": F.when(posts >= 20, F.floor(10 * clicks / F.greatest(posts, F.lit(1)))).otherwise(0),
        "readthrough": F.count_distinct(F.when(kind("view") & (value >= 85), item * 100 + F.col("event_id") % 100)),
        "dwell": F.floor(F.sum(F.when(kind("view"), F.round(value * 100).cast("long")).otherwise(0)) / 100),
        "tenure": F.date_diff(F.lit(AS_OF).cast("timestamp_ntz"), F.min(ts)),
        "nightowl": count(F.hour(ts).between(2, 4)),
        "necro": F.count_distinct(F.when((ts > day("2024-01-20")) & (item < 10), item)),
        "imported": count(ts < day("2024-01-03")),
        "legacy": F.max(F.when(kind("error"), item).otherwise(0)),
        "banner": F.max(F.when(item == 42, 1).otherwise(0)),
    }
    wide = events(spark, sf_dir).groupBy("user_id").agg(*(c.cast("long").alias(n) for n, c in m.items()))
    least = F.element_at(F.create_map(*(F.lit(x) for pair in BADGES.items() for x in pair)), F.col("measure"))
    return wide.unpivot("user_id", list(m), "measure", "n").filter(F.col("n") >= least)


@theme.add(f"SELECT item % 50 AS author, count(*) AS deep, CAST(sum(seconds) AS BIGINT) AS held FROM (SELECT item, user_id, event_id % 20 AS session, max(CAST(floor(value) AS BIGINT)) AS seconds FROM {EVENTS} WHERE event_type = 'view' AND value >= 30 AND item % 50 <> user_id % 50 GROUP BY 1, 2, 3) GROUP BY 1")
def led_deep_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep reads of an author's items by others, one for each session and item."""
    rows = events(spark, sf_dir).filter("event_type = 'view' and value >= 30 and item % 50 <> user_id % 50")
    once = rows.groupBy("item", "user_id", (F.col("event_id") % 20).alias("session")).agg(F.max(F.floor("value")).alias("seconds"))
    return once.groupBy((F.col("item") % 50).alias("author")).agg(F.count(F.lit(1)).alias("deep"), F.sum("seconds").alias("held"))


# From each state the steps that are allowed; others are turned away. An order that is granted and old has expired.
STEPS = {"new": {"click": "pending"}, "pending": {"purchase": "granted", "error": "failed", "view": "refused"}, "granted": {"error": "refunded"}}
MOVE = "CASE " + " ".join(f"WHEN s = '{a}' AND k = '{k}' THEN '{b}'" for a, steps in STEPS.items() for k, b in steps.items()) + " END"


@theme.add(f"""
WITH RECURSIVE e AS (SELECT user_id, item, event_type AS k, ts, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) AS i FROM {EVENTS}),
f AS (SELECT user_id, item, i, CASE k WHEN 'click' THEN 'pending' ELSE 'new' END AS s, CASE k WHEN 'click' THEN 0 ELSE 1 END AS refused, CASE k WHEN 'click' THEN ts END AS moved FROM e WHERE i = 1 UNION ALL
  SELECT user_id, item, i, coalesce(m, s), refused + CASE WHEN m IS NULL THEN 1 ELSE 0 END, CASE WHEN m IS NULL THEN moved ELSE ts END FROM (SELECT e.user_id, e.item, e.i, f.s, f.refused, f.moved, e.ts, {MOVE.replace("s =", "f.s =").replace("k =", "e.k =")} AS m FROM f JOIN e ON e.user_id = f.user_id AND e.item = f.item AND e.i = f.i + 1))
SELECT user_id, item, CASE WHEN s = 'granted' AND moved < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY THEN 'expired' ELSE s END AS state, CAST(refused AS BIGINT) AS refused FROM f QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY i DESC) = 1""")
def led_order_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each order after its events in turn: steps that its state doesn't allow are turned away and counted."""
    rows = events(spark, sf_dir).groupBy("user_id", "item").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("event_type").alias("kind")))).alias("steps"))
    start = F.struct(F.lit("new").alias("state"), F.lit(0).cast("long").alias("refused"), F.lit(None).cast("timestamp_ntz").alias("at"))

    def step(s, e):
        to = F.lit(None).cast("string")
        for state, moves in STEPS.items():
            for kind, then in moves.items():
                to = F.when((s["state"] == state) & (e["kind"] == kind), then).otherwise(to)
        moved = to.isNotNull()
        return F.struct(
            F.coalesce(to, s["state"]).alias("state"), (s["refused"] + F.when(moved, 0).otherwise(1)).alias("refused"),
            F.when(moved, e["ts"]).otherwise(s["at"]).alias("at")
        )

    end = rows.select("user_id", "item", F.aggregate("steps", start, step).alias("s"))
    old = F.col("s.at") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 14 days")
    return end.select("user_id", "item", F.when((F.col("s.state") == "granted") & old, "expired").otherwise(F.col("s.state")).alias("state"), "s.refused")


@theme.add(f"""
WITH p AS (SELECT user_id, item, min(ts) AS paid FROM {EVENTS} WHERE event_type = 'purchase' GROUP BY 1, 2), g AS (SELECT user_id, item, min(ts) AS granted FROM {EVENTS} WHERE event_type = 'signup' GROUP BY 1, 2),
c AS (SELECT user_id, item, max(ts) AS opened FROM {EVENTS} WHERE event_type = 'click' GROUP BY 1, 2), r AS (SELECT user_id, item, max(ts) AS refunded FROM {EVENTS} WHERE event_type = 'error' GROUP BY 1, 2)
SELECT user_id, item, 'paid, not granted' AS problem FROM p ANTI JOIN g USING (user_id, item) UNION ALL SELECT user_id, item, 'granted, not paid' FROM g ANTI JOIN p USING (user_id, item)
UNION ALL SELECT user_id, item, 'stuck' FROM c ANTI JOIN p USING (user_id, item) WHERE opened < TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR UNION ALL SELECT user_id, item, 'live under refund' FROM g JOIN r USING (user_id, item) WHERE granted < refunded""")
def led_reconcile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four problems between payments, grants, opened orders and refunds, from one aggregate per order."""
    at = lambda kind, pick: pick(F.when(F.col("event_type") == kind, F.col("ts")))
    rows = events(spark, sf_dir).groupBy("user_id", "item").agg(
        at("purchase", F.min).alias("paid"), at("signup", F.min).alias("granted"), at("click", F.max).alias("opened"),
        at("error", F.max).alias("refunded")
    )
    paid, granted = F.col("paid").isNotNull(), F.col("granted").isNotNull()
    old = F.col("opened") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 1 hour")
    found = [
        F.when(paid & ~granted, "paid, not granted"), F.when(granted & ~paid, "granted, not paid"), F.when(old & ~paid, "stuck"),
        F.when(F.col("granted") < F.col("refunded"), "live under refund")
    ]
    return rows.select("user_id", "item", F.explode(F.array_compact(F.array(*found))).alias("problem"))


KINDS_KNOWN = ("view", "click", "purchase", "signup")


@theme.add(f"""
WITH p AS (SELECT item, user_id, list_distinct(list(event_type)) AS kinds, CAST(sum(CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS score FROM {EVENTS} GROUP BY ALL)
SELECT item, user_id, kind, CASE WHEN len(kinds) = 1 THEN score END AS n, len(kinds) = 1 AND score IS NOT NULL AS exact FROM p, unnest(kinds) AS k(kind) WHERE kind IN {KINDS_KNOWN}""")
def led_legacy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post's total is known by kind only where one kind was met; it is never shared out. Kinds without a successor are left out."""
    worth = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 2 == 0, 1).otherwise(2)
    rolled = events(spark, sf_dir).groupBy("item", "user_id").agg(F.collect_set("event_type").alias("kinds"), F.sum(worth.cast("long")).alias("score"))
    single = F.size("kinds") == 1
    rows = rolled.select("item", "user_id", F.explode("kinds").alias("kind"), F.when(single, F.col("score")).alias("n"), (single & F.col("score").isNotNull()).alias("exact"))
    return rows.filter(F.col("kind").isin(*KINDS_KNOWN))


QUEUED = f"(SELECT CASE WHEN event_type = 'signup' THEN 'group' ELSE 'item' END AS kind, CASE WHEN event_type = 'signup' THEN item % 7 ELSE item END AS id, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS action FROM {EVENTS} WHERE event_type IN ('error', 'click', 'signup'))"


@theme.add(f"""
WITH q AS (SELECT id AS item, event_id, action FROM {QUEUED} WHERE kind = 'item' UNION ALL SELECT p_partkey, event_id, action FROM {QUEUED} JOIN part ON p_partkey % 7 = id AND p_partkey < 2000000000 WHERE kind = 'group'),
l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY item ORDER BY event_id DESC) = 1)
SELECT p_partkey AS item, -1::BIGINT AS event_id FROM part WHERE p_partkey NOT IN (SELECT item FROM l) UNION ALL SELECT item, event_id FROM l WHERE action = 'upsert'""")
def str_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state after its queue, in which an entry for a group stands for all its items."""
    kind = F.col("event_type")
    rows = events(spark, sf_dir).filter("event_type in ('error', 'click', 'signup')")
    queue = rows.select(
        F.when(kind == "signup", "group").otherwise("item").alias("kind"),
        F.when(kind == "signup", F.col("item") % 7).otherwise(F.col("item")).alias("id"), "event_id",
        F.when(kind == "error", "delete").otherwise("upsert").alias("action")
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("item"))
    members = part.select((F.col("item") % 7).alias("id"), "item")
    state = part.select("item", F.lit(-1).cast("long").alias("event_id"))
    return applied(state, expanded(queue, members, "item", "event_id"), ["item"], "event_id")


@theme.add("SELECT CASE WHEN attempts >= 10 THEN 'dead' WHEN available_at <= TIMESTAMP '2024-01-15' THEN 'due' ELSE 'waiting' END AS place, count(*) AS n, CAST(max(attempts) AS INTEGER) AS most FROM (SELECT CAST(event_id % 12 AS INTEGER) AS attempts, ts + to_seconds(least(300, CAST(pow(2, least(event_id % 12, 8)) AS INTEGER))) AS available_at FROM events WHERE event_type = 'error') GROUP BY 1")
def str_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed entries that are due, those that wait, and those that were tried ten times and go to a table of their own."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.col("ts").alias("failed_at"), (F.col("event_id") % 12).cast("int").alias("attempts")
    )
    place = F.when(F.col("attempts") >= 10, "dead").when(F.col("available_at") <= F.lit("2024-01-15").cast("timestamp_ntz"), "due").otherwise("waiting")
    return retry_at(rows).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.max("attempts").alias("most"))


@theme.add(f"""
WITH p AS (SELECT event_id, user_id, false AS gone FROM events WHERE event_id > 500 AND event_type <> 'error' ORDER BY event_id LIMIT 40), t AS (SELECT event_id, user_id, true AS gone FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-30 23:50:00' - INTERVAL 90 MINUTE)
SELECT *, (SELECT count(*) > 40 FROM (SELECT 1 FROM events WHERE event_id > 500 AND event_type <> 'error' LIMIT 41)) AS truncated FROM (SELECT * FROM p UNION ALL SELECT * FROM t)""")
def str_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page beyond a cursor, whether there is more, and what was taken away lately."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    ahead = after(rows.filter("event_type <> 'error'").select("event_id", "user_id"), "event_id", 500, 41)
    lately = F.col("ts") > F.lit("2024-01-30 23:50:00").cast("timestamp_ntz") - F.expr("interval 90 minutes")
    gone = rows.filter((F.col("event_type") == "error") & lately).select("event_id", "user_id", F.lit(True).alias("gone"))
    more = ahead.agg((F.count(F.lit(1)) > 40).alias("truncated"))
    shown = ahead.orderBy("event_id").limit(40).select("event_id", "user_id", F.lit(False).alias("gone"))
    return shown.unionByName(gone).crossJoin(F.broadcast(more))  # one row


@theme.add("""
WITH g AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase' AND event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type = 'error')),
i AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island, day FROM g)
SELECT user_id, max(n) AS best, max(CASE WHEN stop >= DATE '2024-01-30' THEN n ELSE 0 END) AS running FROM (SELECT user_id, island, count(*) AS n, max(day) AS stop FROM i GROUP BY 1, 2) GROUP BY 1""")
def str_streak_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks after deletes: recomputed from the rows that are left, so a late delete splits or shortens them."""
    rows = table(spark, sf_dir, "events")
    deleted = rows.filter("event_type = 'error'").select((F.col("event_id") - 1).alias("event_id"))
    left = rows.filter("event_type = 'purchase'").join(deleted, "event_id", "left_anti")
    runs = streaks(left, "user_id", "ts")
    running = F.max(F.when(F.col("stop") >= F.lit("2024-01-30").cast("date"), F.col("length")).otherwise(0))
    return runs.groupBy("user_id").agg(F.max("length").alias("best"), running.alias("running"))


@theme.add("SELECT page, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS page FROM events WHERE event_id > 700 QUALIFY page < 3) GROUP BY 1")
def src_resumed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of a scan that goes on after a cursor; the last id of each is the cursor of the next."""
    rows = after(table(spark, sf_dir, "events").select("event_id"), "event_id", 700, 300)
    paged = rows.withColumn("page", F.floor((F.row_number().over(Window.orderBy("event_id")) - 1) / 100))  # three pages
    return paged.groupBy("page").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@theme.add("SELECT shard, count(*) AS n, max(event_id) AS cursor FROM (SELECT event_id, event_id % 4 AS shard FROM events) JOIN (VALUES (0, 100), (1, 2000), (2, -1), (3, 555)) AS c(s, beyond) ON s = shard AND event_id > beyond GROUP BY 1")
def src_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by the id's remainder, each read beyond a cursor of its own."""
    rows = shards(table(spark, sf_dir, "events").select("event_id"), "event_id", 4, {0: 100, 1: 2000, 3: 555})
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("cursor"))


@theme.add("WITH b AS (SELECT min(o_orderkey) - 1 AS lo, max(o_orderkey) AS hi FROM orders) SELECT CAST(i AS INTEGER) AS part, count(*) AS n FROM orders, b, range(6) AS r(i) WHERE o_orderkey > lo + (hi - lo) * i // 6 AND o_orderkey <= lo + (hi - lo) * (i + 1) // 6 GROUP BY 1")
def src_id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of six ranges of ids, cut between the least and the greatest."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    low, high = rows.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    if low is None:
        return rows.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("n")).limit(0)
    part = F.lit(None).cast("int")
    for i, (a, b) in enumerate(id_ranges(low - 1, high, 6)):
        part = F.when((F.col("o_orderkey") > a) & (F.col("o_orderkey") <= b), i).otherwise(part)
    return rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@theme.add(f"SELECT a.item, a.n, round(a.n / b.most, 6) AS share FROM (SELECT item, count(*) AS n FROM {EVENTS} GROUP BY 1) a, (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM {EVENTS} GROUP BY item)) b")
def snk_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intermediate that is written once and read twice."""
    rolled = materialised(events(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("n")), "rolled")
    return rolled.crossJoin(F.broadcast(rolled.agg(F.max("n").alias("most")))).select("item", "n", F.round(F.col("n") / F.col("most"), 6).alias("share"))  # one row


@theme.add(f"SELECT item, count(*) AS n FROM {EVENTS} WHERE event_type = 'view' GROUP BY 1")
def snk_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is rebuilt: the second write takes the place of the first."""
    rows = events(spark, sf_dir)
    folder = rebuilt(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "rebuild")
    rebuilt(rows.filter("event_type = 'view'").groupBy("item").agg(F.count(F.lit(1)).alias("n")), "rebuild", folder)
    return spark.read.parquet(folder)


@theme.add("SELECT doc_id, lang, CAST(length(substr(text, 1, 200)) AS BIGINT) AS chars, md5(substr(text, 1, 200)) AS snippet_md5 FROM documents WHERE text IS NOT NULL")
def snk_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets exported as JSON lines and read back."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "lang", F.substring("text", 1, 200).alias("snippet"))
    read = spark.read.schema("doc_id long, lang string, snippet string").json(exported(rows, "snippets", rows_per_file=5000))
    return read.select("doc_id", "lang", F.char_length("snippet").cast("long").alias("chars"), F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"))


LINE = """'{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}'"""


@theme.add(f"SELECT CAST(sum(length({LINE}) + 1) AS BIGINT) AS bytes, count(*) AS n, coalesce(max(length({LINE}) + 1) <= 4000, true) AS bounded, true AS filled FROM events")
def snk_json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in batches of 4,000 bytes and 50 rows at most: what all of them hold, whether each is within its bounds, and whether
    each but the last of its partition is filled, so that the longest line would not have fitted in as well."""
    return batch_report(json_batches(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 4000, 50), 4000, 50)


def batch_report(batches: DataFrame, most_bytes: int, most_rows: int) -> DataFrame:
    """bytes and n of all of json_batches(), bounded and filled."""
    longest = F.max(F.array_max(F.transform(F.split("lines", "\n"), F.octet_length)) + 1)
    least = F.min(F.when((F.col("n") < most_rows) & ~F.col("last"), F.col("bytes")))
    bounded = (F.max("n") <= most_rows) & (F.max("bytes") <= most_bytes)
    return batches.agg(
        F.sum("bytes").alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(bounded, F.lit(True)).alias("bounded"),
        F.coalesce(least + longest > most_bytes, F.lit(True)).alias("filled")
    )


@theme.add("""
WITH RECURSIVE v AS (SELECT event_id, user_id, item, date_sub('second', TIMESTAMP '2024-01-01', ts) AS s FROM """ + EVENTS + """ WHERE event_type = 'view' AND event_id % 4 <> 3 AND event_id % 6 <> 5),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, item % 20 ORDER BY s, event_id) AS i, item % 20 AS page FROM v),
f AS (SELECT user_id, page, event_id, i, s AS last, true AS kept FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.page, e.event_id, e.i, CASE WHEN e.s - f.last >= 86400 THEN e.s ELSE f.last END, e.s - f.last >= 86400 FROM f JOIN e ON e.user_id = f.user_id AND e.page = f.page AND e.i = f.i + 1)
SELECT event_id, user_id, page FROM f WHERE kept""")
def src_view_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that count: of pages that succeeded, by no robot, a day or more after the viewer's last one of the page that did."""
    i = F.col("event_id")
    path = F.concat(F.when(i % 4 == 3, "/admin/").otherwise("/d/"), (F.col("item") % 20).cast("string"))
    agent = F.when(i % 6 == 5, "ExampleBot/1.0 (+crawler)").otherwise("Mozilla/5.0")
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    hits = events(spark, sf_dir).filter("event_type = 'view'").select("event_id", "user_id", path.alias("path"), agent.alias("agent"), seconds.alias("seconds"))
    people = hits.filter(F.col("path").rlike(r"^/d/\d+$") & ~F.col("agent").rlike(r"(?i)bot|crawl|spider|slurp"))
    rows = people.select("event_id", "user_id", F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("page"), "seconds")
    return accepted_rows(rows, ["user_id", "page"], "seconds", "event_id", gap=86400).filter("accepted").select("event_id", "user_id", "page")


@theme.add("SELECT event_type, count(*) AS n, CAST(sum(least(greatest(CAST(floor(value * 20000) AS BIGINT), 0), 3600000)) AS BIGINT) AS dwell_ms, CAST(sum(least(greatest(CAST(floor(value) AS BIGINT) - 20, 0), 100)) AS BIGINT) AS read_pct FROM (SELECT *, row_number() OVER (PARTITION BY event_id // 70 ORDER BY event_id) AS i FROM events) WHERE i <= 50 AND event_type IN ('view', 'click', 'purchase') GROUP BY 1")
def src_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they are sent, JSON lines in requests: known kinds, fifty of a request, clamped numbers."""
    rows = table(spark, sf_dir, "events").select(
        "event_type", F.floor(F.col("value") * 20000).alias("dwell_ms"), (F.floor("value") - 20).alias("read_pct"),
        F.floor(F.col("event_id") / 70).alias("request"), "event_id"
    )
    sent = exported(rows, "requests", rows_per_file=100_000)
    read = read_events_json(
        spark, sent, "event_type string, dwell_ms long, read_pct long, request long, event_id long", ["view", "click", "purchase"],
        "request", "event_id"
    )
    return read.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("dwell_ms").alias("dwell_ms"), F.sum("read_pct").alias("read_pct"))


@theme.add("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey % 2 = 0 AS guide FROM nation")
def src_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in JSON documents of several lines, a file each."""
    rows = table(spark, sf_dir, "nation").select(F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") % 2 == 0).alias("guide")).alias("x"))
    folder = shared_path(spark, "verdicts")
    rows.select(F.to_json("x", {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return read_json_document(spark, folder, "id long, name string, guide boolean")


@theme.add("SELECT shard, imported, skipped, cursor FROM (SELECT CAST(event_id % 3 AS INTEGER) AS shard, count_if(event_type <> 'error') AS imported, count_if(event_type = 'error') AS skipped, max(event_id) AS cursor FROM events WHERE event_id > 300 GROUP BY 1)")
def str_resumable_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that goes on after its cursors: rows that are skipped move a shard's cursor as well."""
    rows = shards(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 3, dict.fromkeys(range(3), 300))
    good = F.col("event_type") != "error"
    return rows.groupBy("shard").agg(F.count_if(good).alias("imported"), F.count_if(~good).alias("skipped"), F.max("event_id").alias("cursor"))
