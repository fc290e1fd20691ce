"""Incremental queries: outboxes, cursors, presence, limits and upserts, in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.plans.base import AS_OF, EVENTS, Theme, events, table
from agoraspark.plans.windows import theme as windows
from agoraspark.sources.files import after, balanced, inserted, patched, shared_path, upserted
from agoraspark.streaming.spool import append, capped, replay
from agoraspark.streaming.state import applied, collapsed, drain, retry_at

theme = Theme()
WINDOW_SQL = windows.sql
QUEUE = f"(SELECT item, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS action, user_id FROM {EVENTS} WHERE event_type IN ('error', 'click'))"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("event_type in ('error', 'click')")
    return rows.select("item", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("action"), "user_id")


@theme.add(f"SELECT item, event_id, action, user_id FROM {QUEUE} QUALIFY row_number() OVER (PARTITION BY item ORDER BY event_id DESC) = 1")
def str_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last action for each object of a queue."""
    return collapsed(_queue(spark, sf_dir), ["item"], "event_id").select("item", "event_id", "action", "user_id")


@theme.add(f"""
WITH q AS (SELECT * FROM {QUEUE} QUALIFY row_number() OVER (PARTITION BY item ORDER BY event_id DESC) = 1)
SELECT p_partkey AS item, -1::BIGINT AS event_id, -1::BIGINT AS user_id FROM part WHERE p_partkey NOT IN (SELECT item FROM q) UNION ALL SELECT item, event_id, user_id FROM q WHERE action = 'upsert'""")
def str_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state after its queue."""
    none = F.lit(-1).cast("long")
    state = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("item"), none.alias("event_id"), none.alias("user_id"))
    return applied(state, _queue(spark, sf_dir), ["item"], "event_id")


@theme.add("SELECT event_id, attempts, ts + to_seconds(least(300, CAST(pow(2, least(attempts, 8)) AS INTEGER))) AS available_at FROM (SELECT event_id, ts, CAST(event_id % 12 AS INTEGER) AS attempts FROM events WHERE event_type = 'error')")
def str_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a failed entry is due again."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        "event_id", F.col("ts").alias("failed_at"), (F.col("event_id") % 12).cast("int").alias("attempts")
    )
    return retry_at(rows).select("event_id", "attempts", "available_at")


@theme.add("SELECT event_id, user_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 60")
def str_cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of rows after a cursor."""
    return after(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 500, 60)


@theme.add("SELECT user_id, max(ts) AS seen_at, max(ts) > TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 3 HOUR AS present FROM events WHERE ts <= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1")
def str_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was seen within three hours before a time."""
    now = F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    seen = table(spark, sf_dir, "events").filter(F.col("ts") <= now).groupBy("user_id").agg(F.max("ts").alias("seen_at"))
    return seen.withColumn("present", F.col("seen_at") > now - F.expr("interval 3 hours"))


@theme.add("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY date_sub('second', TIMESTAMP '2024-01-01', ts) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) > 2 AS limited FROM events")
def str_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that make more than two within an hour."""
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    rows = table(spark, sf_dir, "events").withColumn("s", seconds)
    return rows.select("event_id", (F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-3599, 0)) > 2).alias("limited"))


@theme.add("SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * (hour(ts) % 6) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def str_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of six hours."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), "kind", "n")


@theme.add(f"SELECT item, count(*) AS touched, max(ts) AS last_ts FROM {EVENTS} WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY GROUP BY 1")
def str_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects touched lately, to be applied again."""
    recent = F.col("ts") > F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 2 days")
    return events(spark, sf_dir).filter(recent).groupBy("item").agg(F.count(F.lit(1)).alias("touched"), F.max("ts").alias("last_ts"))


OLD = "SELECT c_custkey AS custkey, 1::BIGINT AS version, c_acctbal AS balance FROM customer WHERE c_custkey % 2 = 0"
NEW = "SELECT c_custkey AS custkey, CAST(c_custkey % 3 AS BIGINT) AS version, -c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "custkey", "c_acctbal": "balance"})
    old = rows.filter("custkey % 2 = 0").select("custkey", F.lit(1).cast("long").alias("version"), "balance")
    return old, rows.filter("custkey % 3 <> 0").select("custkey", (F.col("custkey") % 3).cast("long").alias("version"), (-F.col("balance")).alias("balance"))


@theme.add(f"SELECT custkey, version, balance FROM (SELECT *, 0 AS new FROM ({OLD}) UNION ALL SELECT *, 1 FROM ({NEW})) QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY version DESC, new DESC) = 1")
def snk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state after an upsert by version."""
    return upserted(*_states(spark, sf_dir), ["custkey"], "version")


@theme.add(f"SELECT custkey, version, balance FROM (SELECT *, 0 AS new FROM ({OLD}) UNION ALL SELECT *, 1 FROM ({NEW})) QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY new) = 1")
def snk_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state after an insert that ignores keys that are there."""
    return inserted(*_states(spark, sf_dir), ["custkey"])


@theme.add(f"SELECT o.custkey, o.version, coalesce(n.balance, o.balance) AS balance FROM ({OLD}) o LEFT JOIN ({NEW}) n USING (custkey)")
def snk_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state after an update of one column."""
    old, new = _states(spark, sf_dir)
    return patched(old, new.select("custkey", "balance"), ["custkey"])


@theme.add("""
WITH b AS (SELECT quantile_disc(conv_id, [0.25, 0.5, 0.75]) AS q FROM conversations), p AS (SELECT conv_id, CAST(len(list_filter(q, lambda x: conv_id > x)) AS INTEGER) AS part FROM conversations, b),
k AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)), t AS (SELECT count(*) AS total FROM conversations)
SELECT part, count(*) AS n, count(DISTINCT conv_id) AS keys, min(conv_id) AS first_key, max(conv_id) AS last_key, abs(count(*) - any_value(total) / 4.0) <= any_value(most) + 1 AS even FROM p, k, t GROUP BY 1""")
def src_balanced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows cut into four ranges of keys: how many each has, from which key to which, and whether it's a quarter but for one key's rows."""
    parts = balanced(table(spark, sf_dir, "conversations"), "conv_id", 4)
    per_key = parts.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    rolled = per_key.groupBy("part").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.min("conv_id").alias("first_key"),
        F.max("conv_id").alias("last_key"), F.max("n").alias("most")
    )
    whole = rolled.agg(F.sum("n").alias("total"), F.max("most").alias("largest"))  # one row
    even = F.abs(F.col("n") - F.col("total") / 4) <= F.col("largest") + 1
    return rolled.crossJoin(F.broadcast(whole)).select("part", "n", "keys", "first_key", "last_key", even.alias("even"))


@theme.add(f"SELECT user_id, event_id FROM ({WINDOW_SQL['win_rolling_cap']}) WHERE accepted")
def str_spool_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that count by a stream over a spool that grows: it is replayed after each of three appends, from its checkpoint on."""
    spool, target, checkpoint = (shared_path(spark, label) for label in ("spool", "spool-kept", "spool-checkpoint"))
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    rows = table(spark, sf_dir, "events").filter("event_type = 'view'").select("user_id", "event_id", seconds.alias("seconds"))
    bounds = [None, 10 * 86400, 20 * 86400, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = rows if low is None else rows.filter(F.col("seconds") >= low)
        append(part if high is None else part.filter(F.col("seconds") < high), spool)
        stream = spark.readStream.schema("user_id long, event_id long, seconds long").json(spool)
        replay(capped(stream, "user_id", "event_id", "seconds", cap=3, span=432000), target, checkpoint)
    return spark.read.parquet(target).select(F.col("key").alias("user_id"), F.col("row").alias("event_id"))


@theme.add(f"""
SELECT item, event_id, action, (SELECT count(*) FROM {QUEUE}) AS sent FROM {QUEUE} QUALIFY row_number() OVER (PARTITION BY item ORDER BY event_id DESC) = 1""")
def snk_outbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an outbox forwards when it is drained as a stream in two runs, collapsed, and how many of its entries are marked as sent."""
    spool, target, checkpoint = (shared_path(spark, label) for label in ("outbox", "outbox-target", "outbox-checkpoint"))
    rows = _queue(spark, sf_dir).drop("user_id")
    for part in (rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 <> 0")):
        append(part, spool)
        drain(spark.readStream.schema("item long, event_id long, action string").json(spool), target, ["item"], "event_id", checkpoint).start().awaitTermination()
    marks = spark.read.parquet(f"{target}-sent").agg(F.count(F.lit(1)).alias("sent"))  # one row
    return collapsed(spark.read.parquet(target).drop("batch"), ["item"], "event_id").crossJoin(F.broadcast(marks)).select("item", "event_id", "action", "sent")
