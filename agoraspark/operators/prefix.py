"""Numbers and running sums within keys in two levels, so that no key and no table is gone through by one task.

Rows are dealt to parts by ranges of key and order. Sums run within each part; what a key has in the parts before is added
from a table of the keys that more than one part holds, of which there are fewer than parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoraspark.sources.files import materialised


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column | None = None, name: str = "place", parts: int | None = None) -> DataFrame:
    """Adds name: the sum of value (1 if not given) over the rows of the key up to this one. No keys: over all rows.

    order should be total. Null keys are one key. Sums are whole numbers.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = F.lit(1).cast("long") if value is None else value.cast("long")
    dealt = materialised(rows.repartitionByRange(n, *keys, *order).select("*", F.spark_partition_id().alias("_part"), added.alias("_value")), "prefix-parts")
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = dealt.groupBy("_part", *keys).agg(F.sum("_value").alias("_sum"))
    spread = held.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", "_sum"))).alias("_sums")).filter(F.size("_sums") > 1)
    before = F.transform("_sums", lambda x, i: F.struct(x["_part"].alias("_at"), F.aggregate(F.slice("_sums", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y["_sum"]).alias("_before")))
    offsets = spread.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.explode(before).alias("_b")).select("*", "_b._at", "_b._before").drop("_b")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys), F.col("_part") == F.col("_at"))
    # a row for each part of a key in several, two for each part at most
    summed = dealt.withColumn("_own", F.sum("_value").over(within)).join(F.broadcast(offsets), same, "left")
    return summed.select(*rows.columns, (F.col("_own") + F.coalesce("_before", F.lit(0).cast("long"))).alias(name))
