"""Ordered folds of a long key as a parallel prefix scan.

A fold whose steps are maps that compose associatively needs no task that sees all of a key. Rows are
cut into chunks by their order number; each chunk is composed to one map, the maps of ``CHUNK`` chunks
to one of the next level, and so on until one is left. Downward, every chunk gets the map of all that
stands before it and applies it to its own rows. A group holds ``CHUNK`` consecutive order numbers of one
key at most, on every level, so one video of any length is spread over as many tasks as it has chunks.

A map is a row of numbers; ``Compose`` joins two blocks of rows, earlier ones left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored

Compose = Callable[[np.ndarray, np.ndarray], np.ndarray]
CHUNK = 4096


def running(maps: np.ndarray, compose: Compose) -> np.ndarray:
    """Row k composed of rows 0 to k, in log2(n) vectorised steps."""
    out, reach = maps, 1
    while reach < len(out):
        out = np.concatenate([out[:reach], compose(out[:-reach], out[reach:])])
        reach *= 2
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).reshape(-1)))


def _total(compose: Compose):
    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        return pa.table([*(table.column(c).slice(0, 1) for c in ("key", "chunk")), _lists(running(_matrix(table.column("map")), compose)[-1:])], names=["key", "at", "map"])

    return total


def _states(compose: Compose, inclusive: bool):
    """Rows of a chunk and the map of all before it to the map of all up to each row (or before it)."""

    def states(rows: pa.Table, before: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        maps = _matrix(rows.column("map"))
        if not len(maps):
            return rows.select(["key", "at", "map"])
        up_to = running(maps, compose)
        first = _matrix(before.column("map")) if before.num_rows else None
        if first is not None and first.shape[1]:
            up_to = compose(np.repeat(first, len(up_to), axis=0), up_to)
        if not inclusive:
            empty = first if first is not None and first.shape[1] else None
            lists = [None if empty is None else empty[0].tolist(), *up_to[:-1].tolist()]
            return pa.table([rows.column("key"), rows.column("at"), pa.array(lists, pa.list_(pa.float64()))], names=["key", "at", "map"])
        return pa.table([rows.column("key"), rows.column("at"), _lists(up_to)], names=["key", "at", "map"])

    return states


def prefix_scan(rows: DataFrame, compose: Compose, chunk: int = CHUNK) -> DataFrame:
    """(key, at, map) to (key, at, map), with the maps of all rows of the key up to this one composed in the order of at.

    at is a whole number, once per key; maps are arrays of one length. Rows without key or at are left
    out. What the driver gets is the least and the largest at.
    """
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, at long, map array<double>"
    level = rows.select("key", F.col("at").cast("long").alias("at"), F.col("map").cast("array<double>").alias("map")).where("key is not null and at is not null")
    least = level.agg(F.min("at")).first()[0]  # numbers from 0 on meet in one chunk in the end
    level = stored(level.withColumn("at", F.col("at") - F.lit(least or 0)), "maps")
    levels = []
    while True:
        level = level.withColumn("chunk", F.floor(F.col("at") / chunk).cast("long"))
        levels.append(level)
        if not level.agg(F.max("chunk")).first()[0]:  # one chunk holds all of every key
            break
        level = stored(level.groupBy("key", "chunk").applyInArrow(_total(compose), schema), "maps")
    before = levels[-1].select("key", F.col("chunk").alias("at"), F.lit(None).cast("array<double>").alias("map")).where("false")
    for k in range(len(levels) - 1, -1, -1):
        right = before.withColumnRenamed("at", "chunk").where("map is not null")
        before = levels[k].groupBy("key", "chunk").cogroup(right.groupBy("key", "chunk")).applyInArrow(_states(compose, inclusive=k == 0), schema)
        before = stored(before, "states") if k else before
    return before.withColumn("at", F.col("at") + F.lit(least or 0))


# ---- maps --------------------------------------------------------------------------------------


def last_known(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Values and, last, whether they are known: the later known ones."""
    return np.where(right[:, -1:] > 0, right, left)


def moved(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Camera maps: eight corner coordinates, six numbers of an affine map, and, last, whether the corners are fixed by now.

    A map that fixes corners forgets what came before; another moves them. Left of it is the earlier map.
    """
    a = right[:, 8:14].reshape(-1, 2, 3)
    corners = left[:, :8].reshape(-1, 4, 2) @ a[:, :, :2].transpose(0, 2, 1) + a[:, None, :, 2]
    b = left[:, 8:14].reshape(-1, 2, 3)
    turn = a[:, :, :2] @ b[:, :, :2]
    shift = (a[:, :, :2] @ b[:, :, 2:])[:, :, 0] + a[:, :, 2]
    both = np.concatenate([corners.reshape(-1, 8), np.concatenate([turn, shift[:, :, None]], axis=2).reshape(-1, 6), left[:, 14:]], axis=1)
    return np.where(right[:, 14:] > 0, right, both)


def sightings(most: int, alpha: float) -> Compose:
    """Stretches of a ball: first and last sighting (frame, x, y each) and what they make of the velocity at the first: keep, dx, dy; NaN without a sighting.

    From one sighting to the next v' = alpha * (step - v * m) + (1 - alpha) * v, with m the frames that the ball was carried on.
    """

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        carried = np.minimum(right[:, 0] - left[:, 3] - 1, most)
        keep = 1 - alpha - alpha * carried
        step = alpha * (right[:, 1:3] - left[:, 4:6])
        # velocity at the last sighting of the left stretch, on to the first of the right one, on through that
        own, add = left[:, 6] * keep, left[:, 7:9] * keep[:, None] + step
        out = np.concatenate([left[:, :3], right[:, 3:6], (own * right[:, 6])[:, None], add * right[:, 6:7] + right[:, 7:9]], axis=1)
        return np.where(np.isnan(right[:, :1]), left, np.where(np.isnan(left[:, :1]), right, out))

    return joined
