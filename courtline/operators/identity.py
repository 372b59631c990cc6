"""Identity over time: slots of unordered players, slots of track ids, and the ball through gaps.

Players of clips are linked for many clips at once, one frame after the other. Track ids hold slots
over stretches of frames, and only the frames where a stretch begins or waits are decided on.
The ball's velocity is a linear recurrence over its sightings; what lies between is a straight line.
Ties are broken by slot and id, so no result depends on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import N_SLOTS
from . import scan

_ORDERS = np.array(list(permutations(range(N_SLOTS))))
_FAR, _CLIPS = 1e7, 256
#: Slot from 0, and its track's id, last frame and place then.
Held = tuple[int, int, int, float, float]


def least_links(cost: np.ndarray) -> np.ndarray:
    """(clips, slots, slots) costs, infinite where there is no pair, to each slot's partner: as many pairs as there can be, of least total cost."""
    padded = np.where(np.isfinite(cost), cost, _FAR)
    total = sum(padded[:, r, _ORDERS[:, r]] for r in range(N_SLOTS))
    return _ORDERS[total.argmin(axis=1)]


def link_clips(grid: np.ndarray, gate: float) -> np.ndarray:
    """(clips, frames, slots, 2) positions in arbitrary slots to slots that follow a player; NaN is missing. No point is dropped."""
    out = grid.copy()
    slot = np.arange(N_SLOTS)
    for t in range(1, grid.shape[1]):
        before, now = out[:, t - 1], grid[:, t]
        cost = np.sqrt(((before[:, :, None] - now[:, None]) ** 2).sum(axis=3))
        partner = least_links(np.where(np.isnan(cost), np.inf, cost))
        linked = np.take_along_axis(cost, partner[:, :, None], axis=2)[:, :, 0] <= gate
        placed = np.where(linked[:, :, None], np.take_along_axis(now, partner[:, :, None], axis=1), np.nan)
        left = ~np.isnan(now).any(axis=2)
        clip, own = np.nonzero(linked)
        left[clip, partner[clip, own]] = False
        # the k-th point that is left takes the k-th slot that is free
        points, free = np.argsort(~left, axis=1, kind="stable"), np.argsort(linked, axis=1, kind="stable")
        clip, k = np.nonzero(slot < left.sum(axis=1)[:, None])
        placed[clip, free[clip, k]] = now[clip, points[clip, k]]
        out[:, t] = placed
    return out


def run_starts(table: pa.Table, n_keys: int) -> np.ndarray:
    """Is a row the first of those with its keys (the first ``n_keys`` columns)?"""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for c in range(n_keys):
        code = pc.fill_null(table.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        out[1:] |= code[1:] != code[:-1]
    return out


def whole_runs(n_keys: int, of: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``of`` over tables of whole runs of equal keys, for mapInArrow on sorted rows; one batch and the run that it cuts are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            if not table.num_rows:
                continue
            cut = int(np.flatnonzero(run_starts(table, n_keys))[-1])
            if cut:
                yield from of(table.slice(0, cut)).combine_chunks().to_batches()
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from of(held).combine_chunks().to_batches()

    return run


def _linked(table: pa.Table, n_keys: int, gate: float) -> pa.Table:
    """Whole clips, sorted by clip, frame and slot, to all their slots."""
    keys = [table.column(c).combine_chunks() for c in range(n_keys)]
    frame, slot = (table.column(n_keys + c).to_numpy() for c in (0, 1))
    xy = np.stack([table.column(n_keys + c).to_numpy(zero_copy_only=False).astype(float) for c in (2, 3)], axis=1)
    clip_starts = run_starts(table, n_keys)
    frame_starts = clip_starts | np.r_[True, frame[1:] != frame[:-1]]
    clip, at = np.cumsum(clip_starts) - 1, np.flatnonzero(frame_starts)
    t = np.cumsum(frame_starts) - 1
    t = t - t[np.flatnonzero(clip_starts)][clip]
    out = np.empty((len(at), N_SLOTS, 2))
    for a in range(0, int(clip[-1]) + 1, _CLIPS):
        lo, hi = np.searchsorted(clip, [a, a + _CLIPS])
        grid = np.full((clip[hi - 1] - a + 1, t[lo:hi].max() + 1, N_SLOTS, 2), np.nan)
        grid[clip[lo:hi] - a, t[lo:hi], slot[lo:hi] - 1] = xy[lo:hi]
        here = slice(*np.searchsorted(at, [lo, hi]))
        out[here] = link_clips(grid, gate)[clip[at[here]] - a, t[at[here]]]
    rows = pa.array(np.repeat(at, N_SLOTS))
    return pa.table([*(k.take(rows) for k in keys), table.column(n_keys).take(rows), pa.array(np.tile(np.arange(1, N_SLOTS + 1, dtype=np.int32), len(at))), *(pa.array(out[:, :, a].reshape(-1), from_pandas=True) for a in (0, 1)), *(c.take(rows) for c in table.columns[n_keys + 4 :])], names=table.column_names)


def recover_identity(positions: DataFrame, gate: float = 250.0, keys: tuple[str, ...] = ("match_id", "sequence"), carried: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """Positions of each clip (keys, frame_id, slot, x, y) in slots that follow a player from frame to frame.

    A link is the assignment of least total distance to the slots of the frame before; links over
    ``gate`` cm are not kept, and what is left takes the lowest free slots. Clips are sorted inside
    their partitions and read batch by batch; a task holds one batch and the clip that it cuts.
    carried: columns that all rows of a frame share, which come out with it. dealt: rows are dealt by clip already.
    """
    kinds = dict(positions.dtypes)
    names = [*keys, "frame_id", "slot", "x", "y", *carried]
    rows = positions.select(*keys, "frame_id", F.col("slot").cast("int").alias("slot"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *carried)
    rows = rows if dealt else rows.repartition(*keys)

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, [*(kinds[k] for k in keys), kinds["frame_id"], "int", "double", "double", *(kinds[c] for c in carried)], strict=True))
    return rows.sortWithinPartitions(*keys, "frame_id", "slot").mapInArrow(whole_runs(len(keys), lambda table: _linked(table, len(keys), gate)), schema)


def stretch_slots(frame: np.ndarray, track: np.ndarray, x: np.ndarray, y: np.ndarray, max_gap: int = 15, per_frame: float = 60.0, cap: float = 250.0, n_slots: int = N_SLOTS, held: list[Held] | None = None) -> np.ndarray:
    """Slot of each row (1..n_slots, 0: none); a track's row per frame at most, rows without a finite place count as unseen.

    A track that is back within ``max_gap`` unseen frames has its slot again. Other tracks first take
    over slots whose own was unseen for that long at most, the nearest pair first, up to ``per_frame``
    a frame and ``cap`` in all; then, by id, the lowest slot that nobody holds; else they wait.
    held: who held which slot when the frames before these ended, brought up to date.
    """
    out = np.zeros(len(frame), np.int32)
    rows = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    rows = rows[np.lexsort((frame[rows], track[rows]))]
    if not len(rows):
        return out
    f, k = frame[rows], track[rows]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (f[1:] != f[:-1] + 1)])  # stretches: a track seen without a gap
    last = np.r_[first[1:], len(rows)] - 1
    start, end, name = f[first].tolist(), f[last].tolist(), k[first].tolist()
    coming = np.lexsort((k[first], f[first])).tolist()[::-1]
    holder, waiting, now = [-1] * n_slots, [], 0
    for slot, name_, end_, x_, y_ in held or ():  # stretches that are over, behind all others
        holder[slot] = len(name)
        name.append(name_)
        end.append(end_)
        last, rows = np.append(last, len(rows)), np.append(rows, len(x))
        x, y = np.append(x, x_), np.append(y, y_)
    while coming or waiting:
        now = now + 1 if waiting and not (coming and start[coming[-1]] <= now) else start[coming[-1]]
        fresh = [s for s in waiting if end[s] >= now]
        back: dict[int, int] = {name[h]: s for s, h in enumerate(holder) if h >= 0 and now - end[h] - 1 <= max_gap}
        taken: dict[int, int] = {}
        while coming and start[coming[-1]] == now:
            s = coming.pop()
            if name[s] in back:
                taken[back[name[s]]] = s
            else:
                fresh.append(s)
        gone = {slot: now - end[h] for slot, h in enumerate(holder) if h >= 0 and end[h] < now and slot not in taken}
        near = []
        for s in fresh:
            at = rows[first[s] + now - start[s]]
            for slot, age in gone.items():
                there = rows[last[holder[slot]]]
                d = float(np.hypot(x[at] - x[there], y[at] - y[there]))
                if age <= max_gap and d <= min(per_frame * age, cap):
                    near.append((d, name[s], slot, s))
        settled: set[int] = set()
        for _, _, slot, s in sorted(near):
            if s not in settled and slot not in taken:
                taken[slot] = s
                settled.add(s)
        open_ = [slot for slot, h in enumerate(holder) if slot not in taken and (h < 0 or now - end[h] > max_gap)]
        waiting = sorted((s for s in fresh if s not in settled), key=name.__getitem__)
        for slot, s in zip(open_, list(waiting), strict=False):
            taken[slot] = s
            waiting.remove(s)
        for slot, s in taken.items():
            holder[slot] = s
            out[rows[first[s] + now - start[s] : last[s] + 1]] = slot + 1
    if held is not None:
        held[:] = [(slot, name[h], end[h], float(x[rows[last[h]]]), float(y[rows[last[h]]])) for slot, h in enumerate(holder) if h >= 0]
    return out


def manage_slots(tracks: DataFrame, max_gap: int = 15) -> DataFrame:
    """Adds slot (1..6) to tracks (video_id, frame, track_id, x, y); a seventh player has none and is left out.

    A video is cut where nobody was seen for so long that no slot is held. Such parts are sorted and read batch by
    batch: a task holds one batch and who had the slots before it, however long a part is.
    """
    kinds = dict(tracks.dtypes)
    rows = tracks.select("video_id", F.col("frame").cast("long").alias("frame"), F.col("track_id").cast("long").alias("track_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    w = W.partitionBy("video_id").orderBy("frame")
    cut = F.coalesce(F.col("frame") - F.lag("frame").over(w) > max_gap + 1, F.lit(False))
    rows = rows.withColumn("__cut", cut.cast("int")).withColumn("__part", F.sum("__cut").over(w.rowsBetween(W.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Held]] = {}

        def slotted(table: pa.Table) -> pa.Table:
            at = [*np.flatnonzero(run_starts(table, 2)).tolist(), table.num_rows]
            slots = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                part = table.slice(lo, hi - lo)
                key = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                own = held.get(key, [])
                held.clear()  # parts come one after the other
                held[key] = own
                slots.append(stretch_slots(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("frame", "track_id", "x", "y")), max_gap=max_gap, held=own))
            slot = np.concatenate(slots)
            return table.drop_columns(["__part"]).append_column("slot", pa.array(slot)).filter(pa.array(slot > 0)).select(["video_id", "frame", "track_id", "x", "y", "slot"])

        yield from whole_runs(3, slotted)(batches)

    rows = rows.select("video_id", "__part", "frame", "track_id", "x", "y").repartition("video_id", "__part").sortWithinPartitions("video_id", "__part", "frame", "track_id")
    out = rows.mapInArrow(run, f"video_id {kinds['video_id']}, frame long, track_id long, x double, y double, slot int")
    return out.withColumn("frame", F.col("frame").cast(kinds["frame"]))


def ball_velocity(frame: np.ndarray, x: np.ndarray, y: np.ndarray, most: int, alpha: float, start: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    """Velocity at each sighting: v' = alpha * (step - v * m) + (1 - alpha) * v, where the ball was carried on for m frames before; ``start`` is the first one's."""
    carried = np.minimum(np.diff(frame) - 1, most).tolist()
    out = [start]
    for m, dx, dy in zip(carried, np.diff(x).tolist(), np.diff(y).tolist(), strict=True):
        (vx, vy), keep = out[-1], 1 - alpha - alpha * m
        out.append((alpha * dx + keep * vx, alpha * dy + keep * vy))
    return np.array(out)


def track_ball(frames: DataFrame, most: int = 12, alpha: float = 0.55, chunk: int = scan.CHUNK) -> DataFrame:
    """Ball of every frame (video_id, frame, ball_x, ball_y; null where not detected) with predictions in short gaps.

    Up to ``most`` frames after a sighting the ball goes on with its smoothed velocity. The
    velocity is a prefix scan over stretches of sightings, which carries the last sighting along; one
    row a frame.
    """
    kind = dict(frames.dtypes)["frame"]
    x, y, at = F.col("ball_x").cast("double"), F.col("ball_y").cast("double"), F.col("frame").cast("double")
    seen, nothing = x.isNotNull() & y.isNotNull(), F.array_repeat(F.lit(float("nan")), 9)
    stretch = F.when(seen, F.array(at, x, y, at, x, y, F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(nothing)
    out = scan.prefix_scan(frames.select(F.col("video_id").alias("key"), F.col("frame").alias("at"), stretch.alias("map")), scan.sightings(most, alpha), chunk)
    m = F.col("at") - F.get("map", F.lit(3))
    known = ~F.isnan(F.get("map", F.lit(0))) & (m <= most)
    place = lambda a: F.when(known, F.get("map", F.lit(4 + a)) + F.get("map", F.lit(7 + a)) * m)
    return out.select(F.col("key").alias("video_id"), F.col("at").cast(kind).alias("frame"), place(0).alias("ball_x"), place(1).alias("ball_y"), F.coalesce(known & (m > 0), F.lit(False)).alias("predicted"))
