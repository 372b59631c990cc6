"""Exact nearest neighbours with pivots, and their vote.

Some rows are pivots. Every row is dealt to the cell of its nearest pivot and keeps its distance to it. A query
first searches the cells nearest to it that hold k rows; the k-th distance found there bounds the
search. By the triangle inequality a cell whose pivot is farther away than this bound and the cell's radius has
nothing nearer, nor has one that lies behind the bisecting plane by more than the bound, nor a row whose own distance to its
pivot differs from the query's by more. What is left is compared. Large cells are cut into slices and queries
into blocks, so a task holds ``SLICE`` rows and ``BLOCK`` queries at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import stored

#: Most pivots, all of which are sent to every task; rows and queries of a task.
PIVOTS, SLICE, BLOCK = 256, 20_000, 4096
FOUND = "query_id long, vec_id long, label int, d2 double"
_ROOM = 1 - 1e-9  # bounds give way to rounding


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((a - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _to_cells(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column(2)), sent.value[0])
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "label", "embedding", "cell", "dist"])

    return run


def _visits(sent, k: int, further: bool):
    """Queries (query_id, embedding, d2 of the k-th neighbour so far or null) to (query_id, embedding, bound, away, cell): their first cells, or the further ones that may have something nearer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, count, radius = sent.value
        apart = _distances(pivots, pivots) if len(pivots) else pivots
        for batch in batches:
            if not batch.num_rows or not len(pivots):
                continue
            d = _distances(_matrix(batch.column(1)), pivots)
            near = np.argsort(d, axis=1, kind="stable")
            have = np.cumsum(count[near], axis=1) - count[near]
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, near, have < k + 1, axis=1)  # a query may be one of the rows
            bound = np.sqrt(np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float), nan=np.inf))
            if further:
                home = d.argmin(axis=1)
                gap = apart[home]
                behind = np.where(gap > 0, (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / (2 * np.where(gap > 0, gap, 1)), 0)
                wanted = ~first & (count > 0) & (np.maximum(d - radius, behind) * _ROOM <= bound[:, None])
            else:
                wanted = first & (count > 0)
            i, cell = np.nonzero(wanted)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(bound[i]), pa.array(d[i, cell]), pa.array(cell.astype(np.int32))], names=["query_id", "embedding", "bound", "away", "cell"])

    return run


def _compare(k: int):
    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if queries.num_rows and rows.num_rows:
            q, m = _matrix(queries.column("embedding")), _matrix(rows.column("embedding"))
            own, label, dist = (rows.column(c).to_numpy() for c in ("vec_id", "label", "dist"))
            for i, (name, bound, away) in enumerate(zip(*(queries.column(c).to_numpy() for c in ("query_id", "bound", "away")), strict=True)):
                at = np.flatnonzero((np.abs(dist - away) * _ROOM <= bound) & (own != name))
                d2 = ((q[i] - m[at]) ** 2).sum(axis=1)
                best = np.lexsort((own[at], d2))[:k]
                for c, v in zip(out, (np.full(len(best), name), own[at[best]], label[at[best]], d2[best]), strict=True):
                    c.append(v)
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("query_id", "vec_id", "label", "d2"), flat, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)})

    return compare


def _best(found: DataFrame, k: int) -> DataFrame:
    first = W.partitionBy("query_id").orderBy("d2", "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


class Cells:
    """Rows (vec_id, label, embedding) dealt to the cells of their pivots, for any number of searches."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS):
        spark = rows.sparkSession
        base = stored(rows.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
        many = max(1, min(pivots, isqrt(base.count())))
        matrix = _matrix(base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(many).select("embedding").toArrow().column(0))
        cells = stored(base.mapInArrow(_to_cells(spark.sparkContext.broadcast((matrix,))), "vec_id long, label int, embedding array<double>, cell int, dist double"), "cells")
        facts = {r.cell: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}  # one row a pivot
        self.count = np.array([facts[c].n if c in facts else 0 for c in range(len(matrix))])
        radius = np.array([facts[c].radius if c in facts else 0.0 for c in range(len(matrix))])
        self.sent = spark.sparkContext.broadcast((matrix, self.count, radius))
        slices = F.array(*(F.lit(ceil(int(n) / SLICE) or 1) for n in self.count)) if len(matrix) else F.array(F.lit(1))
        self.slices = F.get(slices, F.col("cell"))
        self.rows = cells.withColumn("slice", F.pmod(F.xxhash64("vec_id"), self.slices.cast("long")).cast("int"))

    def visits(self, queries: DataFrame, k: int, further: bool) -> DataFrame:
        return queries.mapInArrow(_visits(self.sent, k, further), "query_id long, embedding array<double>, bound double, away double, cell int")

    def search(self, visits: DataFrame, k: int) -> DataFrame:
        """The k best of each visited cell. A cell's queries are cut into blocks by how many visit it, so its rows are copied to these alone; a cell without visits stays where it is."""
        met = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a pivot
        blocks = F.array(*(F.lit(ceil(met.get(c, 0) / BLOCK)) for c in range(max(1, len(self.count)))))
        blocks = F.get(blocks, F.col("cell"))
        keys = ["cell", "slice", "block"]
        left = visits.withColumn("slice", F.explode(F.sequence(F.lit(0), self.slices - 1))).withColumn("block", F.pmod(F.xxhash64("query_id"), blocks.cast("long")).cast("int"))
        right = self.rows.where(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(k), FOUND)


def knn(queries: DataFrame, rows: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """The k nearest rows of each query by squared distance, exactly: query_id, vec_id, label, d2, rank; the lower vec_id first on ties.

    queries and rows have vec_id, embedding (numbers, all of one length) and rows label. A query is no
    neighbour of itself; rows without id or embedding are left out. With fewer than k rows all are told.
    """
    cells = Cells(rows, pivots)
    own = stored(queries.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")), "queries")
    first = stored(_best(cells.search(cells.visits(own.withColumn("d2", F.lit(None).cast("double")), k, False), k), k), "found")
    bound = first.where(F.col("rank") == k).select("query_id", "d2")
    further = cells.search(cells.visits(own.join(bound, "query_id", "left").select("query_id", "embedding", "d2"), k, True), k)
    return _best(first.drop("rank").unionByName(further), k)


def knn_vote(neighbours: DataFrame) -> DataFrame:
    """Label of each query by a vote weighted with 1 / distance; the lowest label on ties."""
    weight = 1 / F.greatest(F.sqrt("d2"), F.lit(1e-12))
    votes = neighbours.groupBy("query_id", "label").agg(F.sum(weight).alias("w"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label"))


def nearest_centre(rows: DataFrame, centres: DataFrame, most: int = 4096) -> DataFrame:
    """Nearest centre (team, centre array) of each row's embedding; the lowest name on ties.

    Centres are compared inside each row, which is not copied; there may be ``most`` of them.
    """
    n = centres.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} centres")
    square = lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)
    one = centres.agg(F.collect_list(F.struct("team", "centre")).alias("all"))
    d2 = lambda c: F.aggregate(F.zip_with("embedding", c["centre"], square), F.lit(0.0), lambda s, v: s + v)
    nearest = F.array_min(F.transform("all", lambda c: F.struct(d2(c).alias("d2"), c["team"].alias("team"))))
    return rows.join(F.broadcast(one)).withColumn("best", nearest).where("best is not null").select("vec_id", "best.team", "best.d2")
