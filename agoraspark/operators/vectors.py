"""Similarity over array columns: cosine top-k of a query set, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoraspark.operators import cells


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_top_k(queries: DataFrame, rows: DataFrame, id_: str, vector: str, k: int, floor: float = -1.0) -> DataFrame:
    """query, id, score, place: the k rows of greatest cosine for each of queries, itself excluded, not below floor.

    rows is a table; its vectors are put into cells once (see operators.cells), and a query meets the cells that can hold one of
    its k. Vectors of another length than most, null ones and zero ones match nothing.
    """
    own = queries.select(F.col(id_).alias("query"), F.col(vector).alias("q"), F.array(F.col(id_).cast("long")).alias("skip"))
    held = cells.kept(rows, id_, vector)
    return cells.search(held, own, k, floor) if held else _none(rows)


def cosine_within(queries: DataFrame, rows: DataFrame, id_: str, vector: str, floor: float) -> DataFrame:
    """query, id, score: all rows whose cosine with a query is floor or more, but for itself."""
    own = queries.select(F.col(id_).alias("query"), F.col(vector).alias("q"), F.array(F.col(id_).cast("long")).alias("skip"))
    held = cells.kept(rows, id_, vector)
    return cells.within(held, own, floor) if held else _none(rows).drop("place")


def _none(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], "query long, id long, score double, place int")


def centroids(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """key, at, value: the mean vector of each group at unit length, one row a dimension.

    Vectors of another size or null are left out; groups whose mean is zero have no rows. Sums combine before the shuffle.
    """
    fit = rows.filter(F.size(vector) == size)
    sums = fit.groupBy(key).agg(*(F.avg(F.col(vector)[i].cast("double")).alias(f"d{i}") for i in range(size)))
    listed = F.array(*(F.col(f"d{i}") for i in range(size)))
    unit = sums.select(key, listed.alias("mean"), norm(listed).alias("length")).filter("length > 0")
    return unit.select(key, F.posexplode(F.transform("mean", lambda x: x / F.col("length"))).alias("at", "value"))
