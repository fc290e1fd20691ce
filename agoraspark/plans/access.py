"""Who sees what, filters and sorts as data, optional columns, lookups by position, progress and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.operators.access import gated, optional, ordered, page, permitted, ranges, since
from agoraspark.operators.matching import by_position, ladder_lookup
from agoraspark.operators.percentiles import nearest_ranks
from agoraspark.operators.sequences import accepted_rows
from agoraspark.plans.base import AS_OF, EVENTS, Theme, events, table

theme = Theme()
THREADS = f"(SELECT event_id AS id, item, user_id, ts, value, [item % 7, item % 5 + 10] AS tags, event_id % 11 = 3 AS is_private, CASE WHEN event_id % 13 = 4 THEN ts END AS hidden_at, event_type = 'error' AS is_locked, event_type = 'signup' AS is_guide, CASE WHEN event_id % 6 = 1 THEN event_id % 100 END AS last_post FROM {EVENTS})"


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return events(spark, sf_dir).select(
        i.alias("id"), "item", "user_id", "ts", "value",
        F.array(F.col("item") % 7, F.col("item") % 5 + 10).alias("tags"),
        (i % 11 == 3).alias("is_private"),
        F.when(i % 13 == 4, F.col("ts")).alias("hidden_at"),
        (F.col("event_type") == "error").alias("is_locked"),
        (F.col("event_type") == "signup").alias("is_guide"),
        F.when(i % 6 == 1, i % 100).alias("last_post"),
    )


@theme.add(f"SELECT id, item FROM {THREADS} WHERE NOT list_has_any(tags, [3, 12]) AND (NOT is_private OR user_id = 8) AND (hidden_at IS NULL OR user_id = 8)")
def flt_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a viewer may see: none with a denied tag, private and hidden ones only if they are theirs."""
    return _threads(spark, sf_dir).filter(permitted([3, 12], F.col("user_id") == 8)).select("id", "item")


@theme.add(f"""
WITH h AS (SELECT id, item, row_number() OVER (ORDER BY value DESC, id) AS place FROM {THREADS} QUALIFY place <= 300), v AS (SELECT DISTINCT p_partkey FROM part WHERE p_size > 25)
SELECT id, place, dropped FROM (SELECT id, place, item, count(*) FILTER (WHERE item NOT IN (SELECT p_partkey FROM v)) OVER () AS dropped FROM h) WHERE item IN (SELECT p_partkey FROM v)""")
def flt_second_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hundred hits, checked again against what is visible in the source table, with how many were dropped."""
    hits = _threads(spark, sf_dir).orderBy(F.desc("value"), "id").limit(300)
    placed = hits.select("id", "item", F.row_number().over(Window.orderBy(F.desc("value"), "id")).cast("long").alias("place"))  # 300 rows
    visible = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("item"))
    return gated(placed, visible, "item").select("id", "place", "dropped")


ASKED_RANGES = {"value": [(">=", 10), ("<", 50)], "item": [("..", (5, 90))], "replies": [(">", 3)]}


@theme.add(f"SELECT id, (SELECT list(f ORDER BY f) FROM (VALUES ('value'), ('item'), ('replies')) AS u(f) WHERE f NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM {THREADS}))) AS ignored FROM {THREADS} WHERE value >= 10 AND value < 50 AND item BETWEEN 5 AND 90")
def flt_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges by field; those on fields that this kind of row lacks are left out and named."""
    condition, ignored = ranges(ASKED_RANGES, {"value": "value", "item": "item", "replies": None})
    return _threads(spark, sf_dir).filter(condition).select("id", F.array(*map(F.lit, ignored)).alias("ignored"))


@theme.add(f"SELECT id FROM {THREADS} WHERE NOT is_locked AND is_guide AND last_post IS NULL")
def flt_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by name, negated by a mark; those that this kind of row doesn't know are left out."""
    known = {"locked": F.col("is_locked"), "guide": F.col("is_guide"), "unanswered": F.col("last_post").isNull(), "first": None}
    condition = F.lit(True)
    for flag in ("!locked", "guide", "unanswered", "first", "unheard-of"):
        holds = known.get(flag.lstrip("!"))
        if holds is not None:
            condition = condition & (~holds if flag.startswith("!") else holds)
    return _threads(spark, sf_dir).filter(condition).select("id")


SPANS = {"7d": "INTERVAL 7 DAY", "3w": "INTERVAL 21 DAY", "1mo": "INTERVAL 1 MONTH", "1y": "INTERVAL 1 YEAR", "12h": "INTERVAL 12 HOUR"}


@theme.add("SELECT span, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS span FROM events WHERE ts > TIMESTAMP '{AS_OF}' - {v}" for k, v in SPANS.items()) + " UNION ALL SELECT 'yesterday' FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31' UNION ALL SELECT '2024-01' FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01') GROUP BY 1")
def flt_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows lie in each of some spans as users write them: back from now, named days, a month whole."""
    met = [F.when(since(F.col("ts"), span, AS_OF), F.lit(span)) for span in [*SPANS, "yesterday", "2024-01"]]
    rows = table(spark, sf_dir, "events").select(F.explode(F.array_compact(F.array(*met))).alias("span"))
    return rows.groupBy("span").agg(F.count(F.lit(1)).alias("n"))


@theme.add(f"SELECT id FROM {THREADS} WHERE (last_post IS NULL OR last_post <> user_id) AND (hidden_at IS NULL OR hidden_at > TIMESTAMP '2024-01-20')")
def flt_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not the viewer's own or nobody's; without an end or one to come."""
    other = F.col("last_post").isNull() | (F.col("last_post") != F.col("user_id"))
    live = F.col("hidden_at").isNull() | (F.col("hidden_at") > F.lit("2024-01-20").cast("timestamp_ntz"))
    return _threads(spark, sf_dir).filter(other & live).select("id")


@theme.add("SELECT event_id, CAST(k AS BIGINT) AS k FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 85")
def flt_json_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bound on a number within JSON."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))
    return rows.filter("k >= 85")


@theme.add(f"SELECT id FROM {THREADS} WHERE item IN (1, 2, 3) AND false UNION ALL SELECT id FROM {THREADS} WHERE item = 5")
def flt_no_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that found nothing filters all away; the other of two lists is left. Parameters that are absent add nothing."""
    rows = _threads(spark, sf_dir)
    none: list[int] = []
    found = rows.filter(F.col("item").isin(none) if none else F.lit(False)).select("id")
    wanted = {"item": 5, "user_id": None, "tags": None}
    condition = F.lit(True)
    for column, value in wanted.items():
        if value is not None:
            condition = condition & (F.col(column) == value)
    return found.unionByName(rows.filter(condition).select("id"))


@theme.add("""
SELECT conv_id, CAST(i AS INTEGER) AS place, roles[i] AS role, CAST(chars[i] AS BIGINT) AS chars, firsts[i] AS first FROM (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(length(text) ORDER BY turn, role, text) AS chars, list(substr(text, 1, 3) ORDER BY turn, role, text) AS firsts FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY 1), range(1, 1000) AS r(i) WHERE i <= len(roles)""")
def prj_parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of roles, lengths and beginnings that run in parallel, as rows again."""
    rows = table(spark, sf_dir, "conversations").filter("text is not null and role is not null")
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    apart = listed.select(
        "conv_id", F.transform("x", lambda x: x["role"]).alias("role"),
        F.transform("x", lambda x: F.char_length(x["text"]).cast("long")).alias("chars"),
        F.transform("x", lambda x: F.substring(x["text"], 1, 3)).alias("first")
    )
    whole = apart.select("conv_id", F.posexplode(F.arrays_zip("role", "chars", "first")).alias("i", "z"))
    return whole.select("conv_id", (F.col("i") + 1).alias("place"), "z.role", "z.chars", "z.first")


@theme.add("SELECT c_custkey AS custkey, c_acctbal AS balance, 'none' AS tier, 0 AS level FROM customer")
def prj_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that a table may lack, with what stands for them."""
    rows = optional(table(spark, sf_dir, "customer"), {"c_acctbal": F.lit(0.0), "tier": F.lit("none"), "level": F.lit(0)})
    return rows.select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"), "tier", "level")


@theme.add("""
SELECT c_custkey AS custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS large
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def join_either_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a partner of one kind or of another, by flags that one pass over the partners gives."""
    flags = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.bool_or(F.col("o_totalprice") > 400000).alias("large")
    ).filter("urgent or large")
    return table(spark, sf_dir, "customer").join(flags, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("custkey"), "urgent", "large")


@theme.add("""
WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), w AS (SELECT doc_id AS conv_id, doc_id % 6 + 1 AS i FROM documents)
SELECT w.conv_id, w.i AS place, a.turn FROM w JOIN a ON a.conv_id = w.conv_id AND a.i = w.i AND w.i <= a.n""")
def join_nth_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row at a wanted place of a key's sequence, where the sequence is as long."""
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), (F.col("doc_id") % 6 + 1).alias("place"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("row"))
    return by_position(wanted, rows, "conv_id", "place", "row").select("conv_id", "place", F.col("row.turn").alias("turn"))


@theme.add(f"""
SELECT user_id, rank, until_ts FROM (SELECT user_id, CAST(item % 4 AS BIGINT) AS rank, CASE WHEN event_id % 9 <> 2 THEN ts + INTERVAL 10 DAY END AS until_ts FROM {EVENTS} WHERE event_type = 'purchase')
WHERE until_ts IS NULL OR until_ts > TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, until_ts DESC NULLS FIRST) = 1""")
def join_open_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rank among intervals that hold at a time, one without end before any other."""
    now = F.lit(AS_OF).cast("timestamp_ntz")
    held = events(spark, sf_dir).filter("event_type = 'purchase'").select(
        "user_id", (F.col("item") % 4).alias("rank"),
        F.when(F.col("event_id") % 9 != 2, F.col("ts") + F.expr("interval 10 days")).alias("until_ts")
    )
    live = held.filter(F.col("until_ts").isNull() | (F.col("until_ts") > now))
    best = live.groupBy("user_id").agg(F.max(F.struct("rank", F.col("until_ts").isNull().alias("open"), "until_ts")).alias("x"))
    return best.select("user_id", "x.rank", "x.until_ts")


@theme.add("""
SELECT event_type, p, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) JOIN (VALUES (50), (90), (95), (99)) AS q(p) ON i = greatest(1, least(n, CAST(round_even(p * n / 100.0 + 0.5, 0) AS BIGINT)))""")
def agg_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by the nearest rank, rounded half to even."""
    return nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value", [50, 90, 95, 99])


RUNGS = [("stone", 0.0), ("copper", 50000.0), ("silver", 100000.0), ("gold", 150000.0)]


@theme.add("""
WITH s AS (SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) AS points FROM events WHERE event_type = 'purchase' GROUP BY 1),
r AS (SELECT *, CASE WHEN points >= 150000 THEN 150000 WHEN points >= 100000 THEN 100000 WHEN points >= 50000 THEN 50000 ELSE 0 END AS low, CASE WHEN points < 50000 THEN 50000 WHEN points < 100000 THEN 100000 WHEN points < 150000 THEN 150000 END AS high FROM s)
SELECT user_id, CAST(points AS BIGINT) AS points, CAST(greatest(0, high - points) AS BIGINT) AS to_go, CAST(CASE WHEN high IS NULL THEN 100 ELSE least(100, greatest(0, round((points - low) / (high - low) * 100))) END AS BIGINT) AS percent FROM r""")
def win_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user is between their rung and the next; 100 on top."""
    spent = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("points"))
    low = F.element_at(F.create_map(*(F.lit(x) for pair in RUNGS for x in pair)), F.col("rung"))
    share = F.round((F.col("points") - low) / (F.col("next_at") - low) * 100)
    percent = F.when(F.col("next_at").isNull(), 100).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)))
    rows = ladder_lookup(spent, "points", RUNGS)
    return rows.select(
        "user_id", "points", F.greatest(F.lit(0.0), F.col("next_at") - F.col("points")).cast("long").alias("to_go"),
        percent.cast("long").alias("percent")
    )


PAIR_CAP = """
WITH RECURSIVE e AS (SELECT item % 20 AS author, user_id % 50 AS actor, event_id, date_sub('second', TIMESTAMP '2024-01-01', ts) AS s, row_number() OVER (PARTITION BY item % 20, user_id % 50 ORDER BY date_sub('second', TIMESTAMP '2024-01-01', ts), event_id) AS i FROM """


@theme.add(f"""{PAIR_CAP}{EVENTS} WHERE event_type IN ('click', 'view')),
f AS (SELECT author, actor, event_id, i, [s] AS kept, true AS accepted FROM e WHERE i = 1 UNION ALL
  SELECT e.author, e.actor, e.event_id, e.i, CASE WHEN len(list_filter(f.kept, lambda k: e.s - k < 864000)) < 3 THEN list_append(f.kept, e.s) ELSE f.kept END, len(list_filter(f.kept, lambda k: e.s - k < 864000)) < 3
  FROM f JOIN e ON e.author = f.author AND e.actor = f.actor AND e.i = f.i + 1)
SELECT author, actor, event_id, accepted FROM f""")
def win_pair_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of an actor for an author count in any ten days; what is turned away doesn't use the cap up."""
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    rows = events(spark, sf_dir).filter("event_type in ('click', 'view')").select(
        (F.col("item") % 20).alias("author"), (F.col("user_id") % 50).alias("actor"), "event_id", seconds.alias("seconds")
    )
    return accepted_rows(rows, ["author", "actor"], "seconds", "event_id", cap=3, span=864000).select("author", "actor", "event_id", "accepted")


SORTS = {"new": ["-ts"], "old": ["ts"], "top": ["-value"], "active": ["-last_post"], "replies": ["-last_post"], "views": ["-item"], "length": ["-user_id"]}


@theme.add(" UNION ALL ".join(f"SELECT '{name}' AS sort, id, row_number() OVER (ORDER BY {', '.join(f'{c[1:]} DESC NULLS LAST' if c.startswith('-') else f'{c} NULLS LAST' for c in keys)}{', ' if keys else ''}id) AS place FROM {THREADS} QUALIFY place BETWEEN 11 AND 60" for name, keys in {**SORTS, "relevance": ["-ts"]}.items()))
def sort_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of each sort by name; without words to search for, relevance is recency. A page has 1 to 50 rows."""
    rows, out = _threads(spark, sf_dir), None
    for name in [*SORTS, "relevance"]:
        keys = ordered(SORTS, name, default=["-ts"])
        best = page(rows, [*keys, F.col("id")], offset=10, limit=70)
        placed = best.select(F.lit(name).alias("sort"), "id", (F.row_number().over(Window.orderBy(*keys, "id")) + 10).cast("long").alias("place"))  # a page
        out = placed if out is None else out.unionByName(placed)
    return out


@theme.add(f"SELECT least(count(*), 500)::BIGINT AS shown, count(*) > 500 AS truncated FROM {THREADS}")
def sort_capped_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total that is counted up to a limit only, and whether there is more."""
    rows, limit = _threads(spark, sf_dir).select("id"), 500
    n = rows.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(limit).cast("long")).alias("shown"), (F.col("n") > limit).alias("truncated"))
