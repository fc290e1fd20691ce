"""Event rollups and time-decayed ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.plans.base import AS_OF, EVENTS, Theme, events

theme = Theme()


@theme.add(f"""
SELECT item, viewers, clicks, round(log10(1 + viewers + 3 * clicks) + greatest(0.0, 1 - date_sub('hour', last_ts, TIMESTAMP '{AS_OF}') / 168.0), 4) AS hotness
FROM (SELECT item, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewers, count_if(event_type = 'click') AS clicks, max(ts) AS last_ts FROM {EVENTS} GROUP BY 1)""")
def event_hotness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-weighted activity of each item plus a freshness bonus that fades in a week."""
    rolled = (
        events(spark, sf_dir)
        .groupBy("item")
        .agg(
            F.count_distinct(F.when(F.col("event_type") == "view", F.col("user_id"))).alias("viewers"),
            F.count_if(F.col("event_type") == "click").alias("clicks"),
            F.max("ts").alias("last_ts"),
        )
    )
    hours = F.timestamp_diff("HOUR", F.col("last_ts"), F.lit(AS_OF).cast("timestamp_ntz"))
    score = F.log10(1 + F.col("viewers") + 3 * F.col("clicks")) + F.greatest(F.lit(0.0), 1 - hours / 168.0)
    return rolled.select("item", "viewers", "clicks", F.round(score, 4).alias("hotness"))
