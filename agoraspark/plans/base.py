"""What every theme uses: a collector of queries with their SQL, and the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.shipping import ship_package

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-01-31 00:00:00"


class Theme:
    """Queries of one theme by name, and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied parquet tables, by any path that Spark can read."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the item that props names, 0 where it names none."""
    item = F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as bigint)"), F.lit(0).cast("long"))
    return table(spark, sf_dir, "events").withColumn("item", item)


#: The same in SQL, as a table expression.
EVENTS = "(SELECT *, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS item FROM events)"
