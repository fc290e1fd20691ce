"""Vectors in cells around centres, and exact searches by cosine that read the cells which can hold an answer.

build() takes centres from a bounded sample and writes every vector, at unit length, to the cell of its nearest centre: folders by cell,
large cells in several files. Kept beside are each cell's size and radius, a row for each of CELLS at most.

search() probes in two rounds. A query first meets the nearest cells that hold k vectors; its k-th best so far is a distance that the
others must come within. By the triangle inequality a cell is out if the distance to its centre less its radius is beyond that; the
query meets all others. within() asks for all that reach a score, which is such a distance from the start. Results are those of a
comparison with every vector, up to the rounding of scores (12 digits).

Queries and cells meet in groups of a cell's split and a block of queries, so a large cell or a large set of queries is many
groups, and none holds more than GROUP_ROWS vectors and QUERY_ROWS queries in expectation. Vectors that are null, zero or of another
length than most match nothing. Ids should be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoraspark.sources.files import file_marks, materialised, shared_path

SAMPLE, CELLS, ROUNDS = 20_000, 1024, 12
GROUP_ROWS, QUERY_ROWS = 20_000, 4_000
PROBED = 16  # queries whose cells are listed at a time
SLACK = 1e-9
_BUILT: dict[tuple, Cells] = {}


@dataclass(frozen=True)
class Cells:
    """vectors: cell, id, v. centres, counts and radii are by cell."""

    vectors: DataFrame
    centres: np.ndarray
    counts: np.ndarray
    radii: np.ndarray


def unit(vector: Column) -> Column:
    """The vector at unit length; null for null and zero ones."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(wide, lambda x: x / length))


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Means of the sample's rows by nearest mean, from a fixed start."""
    centres = sample[np.random.default_rng(3).choice(len(sample), n, replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=n)
        np.add.at(sums, nearest, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _distances(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * q @ centres.T))


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def build(rows: DataFrame, id_: str, vector: str) -> Cells | None:
    """The cells of rows; None without a vector."""
    spark, folder = rows.sparkSession, shared_path(rows.sparkSession, "cells")
    units = rows.select(F.col(id_).cast("long").alias("id"), unit(F.col(vector)).alias("v")).filter("id is not null and v is not null")
    sizes = units.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return None
    size, n = sizes
    units = units.filter(F.size("v") == size)
    share = min(1.0, SAMPLE / n)
    drawn = units.filter(F.pmod(F.xxhash64(F.lit("cells"), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * SAMPLE)
    sample = np.array([r["v"] for r in drawn.orderBy("id").collect()]).reshape(-1, size)
    if not len(sample):
        sample = np.array([r["v"] for r in units.limit(SAMPLE).collect()])
    centres = _centres(sample, int(min(CELLS, len(sample), max(1, n**0.5))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = _distances(_matrix(batch.column(1), size), centres)
                cell = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(cell)), cell])], ["id", "v", "cell", "apart"])

    dealt = units.mapInArrow(run, "id long, v array<double>, cell int, apart double")
    dealt.repartition("cell", F.pmod("id", F.lit(max(1, n // (GROUP_ROWS * len(centres))) + 1))).write.partitionBy("cell").parquet(folder)
    vectors = spark.read.schema("id long, v array<double>, apart double, cell int").parquet(folder)
    counts, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect():  # a row a cell
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    return Cells(vectors.drop("apart"), centres, counts, radii)


def kept(rows: DataFrame, id_: str, vector: str) -> Cells | None:
    """The cells of a table, built at their first use in this application."""
    key = (rows.sparkSession.sparkContext.applicationId, id_, vector, file_marks(rows))
    if key not in _BUILT:
        _BUILT[key] = build(rows, id_, vector)
    return _BUILT[key]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, PROBED) for b in batches for i in range(0, b.num_rows, PROBED))


def _probes(cells: Cells, queries: DataFrame, k: int | None) -> DataFrame:
    """The cells that each query meets, by column most (a distance): those within it, or with k given the nearest that hold k vectors.

    With k, skip's items are added to k; without, cells in done are left out.
    """
    centres, counts, radii = cells.centres, cells.counts, cells.radii

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a query may meet every cell, with a copy of its vector and its list for each, so a few are taken at a time
        for batch in _few(batches):
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            apart = _distances(_matrix(column("q"), centres.shape[1]), centres)
            if k is not None:
                order = np.argsort(apart, axis=1, kind="stable")
                wanted = k + column("skip").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                before = np.cumsum(counts[order], axis=1) - counts[order]
                query, place = np.nonzero((before < wanted[:, None]) & (counts[order] > 0))
                cell = order[query, place]
            else:
                near = (apart - radii <= column("most").to_numpy(zero_copy_only=False)[:, None] + SLACK) & (counts > 0)
                for i, done in enumerate(column("done").to_pylist()):
                    near[i, done or []] = False
                query, cell = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(query)) for c in (column("query"), column("q"), column("skip"))] + [pa.array(cell.astype(np.int32))], ["query", "q", "skip", "cell"])

    return queries.mapInArrow(run, "query long, q array<double>, skip array<long>, cell int")


def _met(cells: Cells, probes: DataFrame, n_queries: int, k: int | None, floor: float) -> DataFrame:
    """query, id and score of the best k of each group of a cell's split and a block of queries, from floor on."""
    splits = np.maximum(1, -(-cells.counts // GROUP_ROWS))
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    most = int(splits.max())
    of_cell = F.element_at(F.array(*(F.lit(int(s)) for s in splits)), F.col("cell") + 1) if most > 1 else F.lit(1)
    asked = probes.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).select("*", F.explode(F.sequence(F.lit(0), of_cell - 1)).alias("split"))
    read = sorted(r[0] for r in probes.select("cell").distinct().collect())  # a row a cell
    vectors = cells.vectors.filter(F.col("cell").isin(read)).withColumn("split", F.pmod(F.xxhash64("id"), of_cell).cast("int"))
    vectors = vectors.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn("block", F.col("block").cast("long"))
    size = cells.centres.shape[1]

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and rows.num_rows:
            ids, v = rows.column("id").to_numpy(), _matrix(rows.column("v"), size)
            names, q, skip = queries.column("query").to_numpy(), _matrix(queries.column("q"), size), queries.column("skip").to_pylist()
            for first in range(0, len(names), 256):
                scores = np.round(q[first : first + 256] @ v.T, 12)
                for i, own in enumerate(scores, first):
                    fits = own >= floor
                    if skip[i]:
                        fits &= ~np.isin(ids, skip[i])
                    at = np.flatnonzero(fits)
                    if k is not None and len(at) > k:
                        at = at[own[at] >= np.partition(own[at], len(at) - k)[len(at) - k]]
                        at = at[np.lexsort((ids[at], -own[at]))[:k]]
                    out.append((np.full(len(at), names[i]), ids[at], own[at]))
        return pa.table({"query": np.concatenate([o[0] for o in out]), "id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    keys = ["cell", "split", "block"]
    return asked.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(best, "query long, id long, score double")


def _asked(cells: Cells, queries: DataFrame, skip: bool) -> DataFrame:
    listed = F.col("skip").cast("array<long>") if skip else F.lit(None).cast("array<long>")
    units = queries.select(F.col("query").cast("long").alias("query"), unit(F.col("q")).alias("q"), listed.alias("skip"))
    return materialised(units.filter(F.col("q").isNotNull() & (F.size("q") == cells.centres.shape[1])), "queries")


def _distance(score: Column) -> Column:
    """How far apart vectors of unit length are at that cosine."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * score))


def search(cells: Cells, queries: DataFrame, k: int, floor: float = -1.0, report: dict | None = None) -> DataFrame:
    """query, id, score, place: the k rows of greatest cosine for each of queries (query, q, and skip: ids that don't count).

    report gets the share of all pairs of queries and vectors that were compared.
    """
    asked = _asked(cells, queries, "skip" in queries.columns)
    n = asked.count()
    first = materialised(_probes(cells, asked, k), "probes")
    hits = materialised(_met(cells, first, n, k, floor), "hits")
    worst = hits.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("i") <= k).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    done = first.groupBy("query").agg(F.collect_list("cell").alias("done"))
    reach = F.when(F.col("n") == k, F.greatest("least", F.lit(floor))).otherwise(floor)
    rest = asked.join(worst, "query", "left").join(done, "query", "left").select("query", "q", "skip", _distance(reach).alias("most"), "done")
    second = materialised(_probes(cells, rest, None), "probes")
    if report is not None:
        each = F.element_at(F.array(*(F.lit(int(c)) for c in cells.counts)), F.col("cell") + 1)
        compared = first.select("cell").unionByName(second.select("cell")).agg(F.sum(each.cast("long"))).first()[0] or 0
        report["share"] = compared / max(1, n * int(cells.counts.sum()))
    both = hits.unionByName(_met(cells, second, n, k, floor))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return both.withColumn("place", place).filter(F.col("place") <= k)


def within(cells: Cells, queries: DataFrame, floor: float) -> DataFrame:
    """query, id, score: all rows whose cosine with a query is floor or more."""
    asked = _asked(cells, queries, "skip" in queries.columns)
    reach = asked.withColumn("most", _distance(F.lit(float(floor)))).withColumn("done", F.lit(None).cast("array<int>"))
    return _met(cells, materialised(_probes(cells, reach, None), "probes"), asked.count(), None, floor)
