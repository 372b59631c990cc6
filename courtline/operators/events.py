"""Event labels, intervals, splits of ordered frames, and density grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

#: A density grid's cells, bounds, kernel width and radius.
GRID_X, GRID_Y, LOW, HIGH_X, HIGH_Y, SIGMA, RADIUS = 72, 36, -40.0, 1840.0, 940.0, 1.3, 5


def event_labels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of raw label rows: video_file, anchor_time, tactic_class."""
    read = rows.withColumn("tactic", S.canonical_tactic(F.col("tactic_class"))).withColumn("t", S.hms_to_seconds(F.col("anchor_time")))
    ok = F.col("tactic").isNotNull() & F.col("t").isNotNull()
    window = S.event_window(F.col("tactic"), F.col("t"))
    good = read.where(ok).withColumn("w", window).withColumns({"start_s": F.greatest(F.lit(0.0), F.col("w.start_s")), "end_s": F.col("w.end_s")}).drop("w")
    reason = F.when(F.col("tactic").isNull(), "unknown tactic").otherwise("bad time")
    return good, read.where(~ok).withColumn("reason", reason)


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str = "t_s", start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Points inside intervals (both ends inclusive) of the same key.

    Both sides are dealt to whole seconds, so the join is an equi-join with a filter and not a
    product; an interval takes as many rows as it has seconds.
    """
    left = points.withColumn("__s", F.floor(at).cast("long"))
    right = intervals.withColumn("__s", F.explode(F.sequence(F.floor(start).cast("long"), F.floor(end).cast("long"))))
    return left.join(right, [key, "__s"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__s")


def event_order(events: DataFrame, key: str, pad: float = 0.0) -> DataFrame:
    """Intervals in order of start with padding, never before 0; and the seconds of a video's events up to each."""
    w = W.partitionBy(key).orderBy("start_s", "end_s", "o_orderkey")
    out = events.withColumn("start_s", F.greatest(F.lit(0.0), F.col("start_s") - pad)).withColumn("end_s", F.col("end_s") + pad)
    return out.withColumn("place", F.row_number().over(w).cast("long")).withColumn("seconds", F.sum(F.col("end_s") - F.col("start_s")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def temporal_blocks(frames: DataFrame, keys: tuple[str, ...], n: int = 12, order: str = "frame_id") -> DataFrame:
    """Adds pos (place in time order from 0) and block 0..n-1 with bounds round(i * rows / n)."""
    w = W.partitionBy(*keys)
    rows = frames.withColumn("pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    bound = lambda i: F.bround(i * F.col("__n") / n)
    block = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), bound), lambda b: b <= F.col("pos")))
    return rows.withColumn("block", block).drop("__n")


def spread_blocks(n: int = 12, share: float = 0.15) -> list[int]:
    """Which of n blocks validate: about ``share`` of them, evenly spread."""
    k = max(1, round(share * n))
    return sorted({int((i + 0.5) * n / k) for i in range(k)})


def quarantine(rows: DataFrame, keys: tuple[str, ...], gap: int = 1) -> DataFrame:
    """Adds split: val, gap (training rows within ``gap`` places of a validation row) or train. Needs is_val and pos."""
    near = F.max(F.col("is_val").cast("int")).over(W.partitionBy(*keys).orderBy("pos").rangeBetween(-gap, gap)) == 1
    return rows.withColumn("split", F.when(F.col("is_val"), "val").when(near, "gap").otherwise("train"))


def temporal_split(frames: DataFrame, keys: tuple[str, ...], n: int = 12, share: float = 0.15, gap: int = 1) -> DataFrame:
    """Contiguous blocks, a spread of them for validation, and a quarantine around those."""
    rows = temporal_blocks(frames, keys, n)
    return quarantine(rows.withColumn("is_val", F.col("block").isin(spread_blocks(n, share))), keys, gap)


def cell_counts(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of points per cell of a grid of 72 x 36; the last cells include their far edge, points outside and empty cells are left out."""
    cell = lambda c, high, n: F.least(F.floor((F.col(c) - LOW) / ((high - LOW) / n)), F.lit(n - 1)).cast("int")
    inside = F.col("x").between(LOW, HIGH_X) & F.col("y").between(LOW, HIGH_Y)
    # generated rows, not a filter: a condition would be pushed down and x and y, if they are computed, with it many times over
    cells = F.inline(F.when(inside, F.array(F.struct(cell("x", HIGH_X, GRID_X).alias("bx"), cell("y", HIGH_Y, GRID_Y).alias("b2")))))
    return points.select(*keys, cells).groupBy(*keys, "bx", "b2").agg(F.count("*").alias("n"))


def density_grid(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """cell_counts() with all cells of the grid."""
    grid = points.select(*keys).distinct() if keys else points.sparkSession.range(1).select()
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID_X - 1))).alias("bx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID_Y - 1))).alias("b2"))
    return grid.join(cell_counts(points, keys), [*keys, "bx", "b2"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def kernel_weights() -> list[float]:
    from math import exp

    raw = [exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    return [v / sum(raw) for v in raw]


def density_smooth(grid: DataFrame, keys: tuple[str, ...] = (), least: float = 0.03) -> DataFrame:
    """Gaussian smoothing of counts per cell, one axis after the other with reflected edges, over the highest cell; cells under ``least`` are dropped.

    grid: keys, bx, b2, n; cells without a row are empty. A group is the cells of one key, 2,592 at most.
    """
    kinds = dict(grid.dtypes)
    weights = kernel_weights()

    def smooth(table: pa.Table) -> pa.Table:
        v = np.zeros((GRID_X, GRID_Y))
        v[table.column("bx").to_numpy(), table.column("b2").to_numpy()] = table.column("n").to_numpy()
        for axis, size in ((0, GRID_X), (1, GRID_Y)):
            padded = np.pad(v, [(RADIUS, RADIUS) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            v = sum(w * np.take(padded, range(k, k + size), axis) for k, w in enumerate(weights))
        v = v / v.max() if v.max() > 0 else v
        x, y = np.nonzero((v >= least) & (v > 0))
        own = {k: pa.array([table.column(k)[0].as_py()] * len(x), table.column(k).type) for k in keys}
        return pa.table({**own, "bx": pa.array(x.astype(np.int32)), "b2": pa.array(y.astype(np.int32)), "density": pa.array(v[x, y])})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "bx int, b2 int, density double"])
    return grid.select(*keys, F.col("bx").cast("int").alias("bx"), F.col("b2").cast("int").alias("b2"), F.col("n").cast("double").alias("n")).groupBy(*keys).applyInArrow(smooth, schema)
