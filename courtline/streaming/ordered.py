"""Folds over frames of a stream that come in any order.

A fold over frames needs them in order. Rows are kept in list state, those of a micro-batch packed as one
entry, until the watermark has passed their time; an event-time timer then hands all that are due to the
fold, in order of time, so any order of arrival within the lateness gives the rows of the batch operator.
A key's rows of a micro-batch and of the lateness are all that a task's Python holds at a time. State is all in the state store: a query
that starts again from its checkpoint goes on where it was. A row whose frame was folded
already is not dropped but comes out at once, marked late and otherwise untouched.

State of a key that had no rows for ``IDLE_MS`` of event time is removed; what still comes for that
time is late.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..constants import FPS, N_SLOTS, NET_Y
from ..operators.colours import CLUSTERS, WARMUP_FRAMES, WARMUP_SAMPLES, cluster
from ..operators.identity import link_clips

LATENESS_MS, IDLE_MS = 2_000, 60_000
#: Kept for each key besides the fold's own state: the time up to which frames are folded.
DONE = "done long"
#: Rows of a key that wait: their first and last time, and the rows as an Arrow stream.
HELD = "first long, last long, rows binary"


def packed(rows: pd.DataFrame) -> tuple[int, int, bytes]:
    """One entry of held rows (with t)."""
    batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return int(rows["t"].min()), int(rows["t"].max()), sink.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(rows)).read_pandas()


class OrderedFold(StatefulProcessor):
    """Buffers rows (t, then ``columns``) of a key and folds those that are due; see the module.

    A subclass sets ``columns`` (schema of a row), ``state`` (schema of what the fold carries on) and
    fold(): (key, carried or None, due rows in order) to (carried, result); late(): rows as they come out.
    """

    columns: str
    state: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", HELD)
        self._done = handle.getValueState("done", DONE)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self._carried = handle.getValueState("carried", self.state)

    def load(self) -> tuple | None:
        return tuple(self._carried.get()) if self._carried.exists() else None

    def save(self, carried: tuple) -> None:
        self._carried.update(carried)

    def forget(self) -> None:
        self._carried.clear()

    def fold(self, key: tuple, carried: tuple | None, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows), ignore_index=True)
        # without state the watermark says what was folded, or would have been
        done = self._done.get()[0] if self._done.exists() else timerValues.getCurrentWatermarkInMs() - 1
        late = got["t"].to_numpy() <= done
        fresh = got[~late]
        if len(fresh):
            if not self._done.exists():
                self._done.update((int(done),))
            names = ["t", *(c.split()[0] for c in self.columns.split(", "))]
            self._held.appendValue(packed(fresh[names]))
            self._handle.registerTimer(int(fresh["t"].min()))
        if late.any():
            yield self.late(key, got[late])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        if self._done.exists() and expiredTimerInfo.getExpiryTimeInMs() <= self._done.get()[0]:
            return  # another timer's fold took these rows
        held = [tuple(r) for r in self._held.get()] if self._held.exists() else []
        if any(r[0] <= now for r in held):
            rows = pd.concat([unpacked(r[2]) for r in held if r[0] <= now], ignore_index=True)
            late = rows["t"].to_numpy() > now
            rest = [*([packed(rows[late])] if late.any() else []), *(r for r in held if r[0] > now)]
            if rest:
                self._held.put(rest)
                self._handle.registerTimer(min(r[0] for r in rest))
            else:
                self._held.clear()
            due = rows[~late].sort_values("t", kind="stable")
            last = int(due["t"].max())
            self._done.update((last,))
            self._handle.registerTimer(last + IDLE_MS)
            carried, out = self.fold(key, self.load(), due)
            self.save(carried)
            if len(out):
                yield out
        elif not held and self._done.exists() and now >= self._done.get()[0] + IDLE_MS:
            self._done.clear()
            self.forget()

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: Sequence[str], processor: OrderedFold, schema: str, frame: str = "frame", fps: float = FPS, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """``rows`` of a stream through ``processor``, by keys; a frame's time is its number over ``fps``.

    The processor is given the time as t. The watermark's own column is left behind, so late rows
    reach the processor and aren't dropped on the way.
    """
    t = F.floor(F.col(frame) * 1000 / fps).cast("long")
    timed = rows.withColumn("t", t).withColumn("__ts", F.timestamp_millis("t")).withWatermark("__ts", f"{lateness_ms} milliseconds").drop("__ts")
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


# ---- identity ----------------------------------------------------------------------------------


class _Identity(OrderedFold):
    columns = "frame_id long, slot int, x double, y double"
    state = "x array<double>, y array<double>"

    def __init__(self, gate: float, keys: Sequence[str]):
        self.gate, self.keys = gate, tuple(keys)

    def fold(self, key: tuple, carried: tuple | None, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        frame, of = np.unique(due["frame_id"].to_numpy(dtype=np.int64), return_inverse=True)
        grid = np.full((1, len(frame) + (carried is not None), N_SLOTS, 2), np.nan)
        at = of + (carried is not None)
        for a, c in enumerate("xy"):
            grid[0, at, due["slot"].to_numpy(dtype=int) - 1, a] = due[c].to_numpy(dtype=float)
            if carried is not None:  # the last frame that was linked stands before the new ones
                grid[0, 0, :, a] = np.array(carried[a], float)
        linked = link_clips(grid, self.gate)[0]
        out = linked[int(carried is not None) :].reshape(-1, 2)
        rows = pd.DataFrame({**{k: np.repeat(v, len(out)) for k, v in zip(self.keys, key, strict=True)}, "frame_id": np.repeat(frame, N_SLOTS), "slot": np.tile(np.arange(1, N_SLOTS + 1, dtype=np.int32), len(frame)), "x": out[:, 0], "y": out[:, 1], "late": False})
        return tuple(linked[-1, :, a].tolist() for a in (0, 1)), rows

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**dict(zip(self.keys, key, strict=True)), late=True)[[*self.keys, "frame_id", "slot", "x", "y", "late"]]


def live_identity(positions: DataFrame, gate: float = 250.0, keys: tuple[str, ...] = ("match_id", "sequence"), fps: float = FPS, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """recover_identity() of a stream of positions (keys, which are whole numbers, frame_id, slot, x, y), with late (boolean).

    Whole frames are expected to come within the lateness: a frame is linked once.
    """
    rows = positions.select(*(F.col(k).cast("long").alias(k) for k in keys), F.col("frame_id").cast("long").alias("frame_id"), F.col("slot").cast("int").alias("slot"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = ", ".join([*(f"{k} long" for k in keys), "frame_id long", "slot int", "x double", "y double", "late boolean"])
    return in_order(rows, keys, _Identity(gate, keys), schema, "frame_id", fps, lateness_ms)


# ---- slots -------------------------------------------------------------------------------------


def next_slots(held: dict[int, tuple[int, int, float, float]], frame: int, here: dict[int, tuple[float, float]], max_gap: int = 15, per_frame: float = 60.0, cap: float = 250.0, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Slots of the tracks seen in one frame; ``held`` (slot: track, last frame, x, y) is brought up to date.

    The rules are those of stretch_slots(), one frame at a time: who holds a slot keeps it; others
    take over the slot of one who is gone, nearest pair first; then, by id, slots that nobody holds.
    """
    for s in [s for s, (track, last, *_) in held.items() if frame - last > max_gap + (track in here)]:
        del held[s]
    got = {track: s for s, (track, *_) in held.items() if track in here}
    pairs = []
    for track in here.keys() - got.keys():
        for s, (other, last, x, y) in held.items():
            d = float(np.hypot(here[track][0] - x, here[track][1] - y))
            if other not in here and d <= min(per_frame * (frame - last), cap):
                pairs.append((d, track, s))
    for _, track, s in sorted(pairs):
        if track not in got and s not in got.values():
            got[track] = s
    free = [s for s in range(1, n_slots + 1) if s not in held and s not in got.values()]
    for track, s in zip(sorted(here.keys() - got.keys()), free, strict=False):
        got[track] = s
    for track, s in got.items():
        held[s] = (track, frame, *here[track])
    return got


class _Slots(OrderedFold):
    columns = "frame long, track_id long, x double, y double"
    state = "slot array<int>, track array<long>, last array<long>, x array<double>, y array<double>"

    def __init__(self, max_gap: int):
        self.max_gap = max_gap

    def fold(self, key: tuple, carried: tuple | None, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        held = {int(s): (int(k), int(f), float(x), float(y)) for s, k, f, x, y in zip(*(carried or ([],) * 5), strict=True)}
        due = due[np.isfinite(due["x"].to_numpy(dtype=float)) & np.isfinite(due["y"].to_numpy(dtype=float))]
        rows = []
        for frame, group in due.groupby("frame", sort=True):
            here = {int(k): (float(x), float(y)) for k, x, y in zip(group["track_id"], group["x"], group["y"], strict=True)}
            got = next_slots(held, int(frame), here, self.max_gap)
            rows += [(key[0], int(frame), k, *here[k], s, False) for k, s in got.items()]
        state = [(s, *held[s]) for s in sorted(held)]
        return tuple([list(c) for c in zip(*state, strict=True)] or [[]] * 5), pd.DataFrame(rows, columns=["video_id", "frame", "track_id", "x", "y", "slot", "late"])

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(video_id=key[0], slot=0, late=True)[["video_id", "frame", "track_id", "x", "y", "slot", "late"]]


def live_slots(tracks: DataFrame, max_gap: int = 15, fps: float = FPS, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """manage_slots() of a stream of tracks (video_id, frame, track_id, x, y), with late (boolean); a late row has slot 0."""
    rows = tracks.select(F.col("video_id").cast("long").alias("video_id"), F.col("frame").cast("long").alias("frame"), F.col("track_id").cast("long").alias("track_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return in_order(rows, ["video_id"], _Slots(max_gap), "video_id long, frame long, track_id long, x double, y double, slot int, late boolean", "frame", fps, lateness_ms)


# ---- team votes --------------------------------------------------------------------------------


def faded_sums(votes: np.ndarray, start: np.ndarray, decay: float) -> np.ndarray:
    """Running sums from the place ``start`` of each row's run on; a vote fades by ``decay`` a row. Each round doubles how far back a sum reaches."""
    out, at, reach = votes.astype(float), np.arange(len(votes)), 1
    while (more := np.flatnonzero(at - reach >= start)).size:
        out[more] += decay**reach * out[more - reach]
        reach *= 2
    return out


class _Votes(OrderedFold):
    """Votes of one track."""

    columns = "frame long, det_id long, team string"
    state = "near double, far double, frame long"

    def __init__(self, decay: float, ratio: float):
        self.decay, self.ratio = decay, ratio

    def fold(self, key: tuple, carried: tuple | None, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        due = due.sort_values(["frame", "det_id"], kind="stable")
        frame, team = due["frame"].to_numpy(dtype=np.int64), due["team"].to_numpy(dtype=object)
        near, far = (team == "NEAR").astype(float), (team == "FAR").astype(float)
        if carried is not None and carried[2] == frame[0] - 1:
            near[0], far[0] = near[0] + self.decay * carried[0], far[0] + self.decay * carried[1]
        anew = np.diff(frame, prepend=frame[0]) != 1  # a track that missed a frame begins anew
        start = np.maximum.accumulate(np.where(anew, np.arange(len(frame)), 0))
        near, far = (faded_sums(v, start, self.decay) for v in (near, far))
        voted = np.where(near > far * self.ratio, "NEAR", np.where(far > near * self.ratio, "FAR", "UNKNOWN"))
        rows = pd.DataFrame({"video_id": key[0], "frame": frame, "det_id": due["det_id"].to_numpy(dtype=np.int64), "track_id": key[1], "near": near, "far": far, "voted": voted.astype(object), "late": False})
        return (float(near[-1]), float(far[-1]), int(frame[-1])), rows

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(video_id=key[0], track_id=key[1], near=np.nan, far=np.nan, voted=None, late=True)[["video_id", "frame", "det_id", "track_id", "near", "far", "voted", "late"]]


def live_votes(dets: DataFrame, decay: float = 0.98, ratio: float = 1.0, fps: float = FPS, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """team_votes() of a stream of detections (video_id, frame, det_id, track_id, team), with late (boolean).

    Each track is a key, so those of a video are folded side by side.
    """
    rows = dets.where("track_id is not null").select(*(F.col(c).cast("long").alias(c) for c in ("video_id", "frame", "det_id", "track_id")), F.col("team").cast("string").alias("team"))
    return in_order(rows, ["video_id", "track_id"], _Votes(decay, ratio), "video_id long, frame long, det_id long, track_id long, near double, far double, voted string, late boolean", "frame", fps, lateness_ms)


# ---- teams by shirt colour ---------------------------------------------------------------------


class _Colours(OrderedFold):
    """Two phases: samples are kept until the warm-up is complete, then clusters are fitted once and only their centres stay."""

    columns = "frame long, det_id long, y double, cx double, cy double, cv double"
    state = "frames long, samples long, fit_frame long, cx array<double>, cy array<double>, cv array<double>, team array<string>"

    def __init__(self, net_y: float, frames: int, samples: int):
        self.net_y, self.frames, self.samples = net_y, frames, samples

    def open(self, handle: StatefulProcessorHandle) -> None:
        super().open(handle)
        self._warm = handle.getListState("warm", self.columns)

    def forget(self) -> None:
        super().forget()
        self._warm.clear()

    def _fit(self, warm: list[tuple]) -> tuple[list, list, list, list]:
        warm = sorted(warm, key=lambda r: r[:2])
        centres, labels = cluster(np.array([r[3:6] for r in warm], float), CLUSTERS)
        y = np.array([r[2] for r in warm], float)
        used = np.unique(labels).tolist()
        teams = ["NEAR" if np.median(y[labels == j]) >= self.net_y else "FAR" for j in used]
        if len(set(teams)) < 2:  # degenerate: the half of the court goes on deciding
            return [], [], [], []
        return *(centres[used, a].tolist() for a in range(3)), teams

    def _half(self, y: float | None) -> str:
        return "UNKNOWN" if y is None or np.isnan(y) else "NEAR" if y >= self.net_y else "FAR"

    def fold(self, key: tuple, carried: tuple | None, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        n_frames, n_samples, fit_frame, cx, cy, cv, teams = carried or (0, 0, -1, [], [], [], [])
        warm, rows = None, []
        for frame, group in due.sort_values(["frame", "det_id"], kind="stable").groupby("frame", sort=True):
            values = [(int(r.frame), int(r.det_id), *(float(v) for v in (r.y, r.cx, r.cy, r.cv))) for r in group.itertuples(index=False)]
            if fit_frame < 0:
                warm = warm if warm is not None else [tuple(r) for r in self._warm.get()] if self._warm.exists() else []
                good = [v for v in values if not np.isnan(v[2])]
                warm += good
                n_frames, n_samples = n_frames + 1, n_samples + len(good)
                rows += [(key[0], *v, self._half(v[2]), False, False) for v in values]
                if n_frames >= self.frames and n_samples >= self.samples:
                    fit_frame, (cx, cy, cv, teams), warm = int(frame), self._fit(warm), None
                    self._warm.clear()
            elif teams:
                c = np.array([cx, cy, cv], float).T
                rows += [(key[0], *v, teams[int(((np.array(v[3:]) - c) ** 2).sum(axis=1).argmin())], True, False) for v in values]
            else:
                rows += [(key[0], *v, self._half(v[2]), False, False) for v in values]
        if warm:
            self._warm.put(warm)
        return (n_frames, n_samples, fit_frame, list(cx), list(cy), list(cv), list(teams)), pd.DataFrame(rows, columns=["video_id", "frame", "det_id", "y", "cx", "cy", "cv", "team", "by_colour", "late"])

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(video_id=key[0], team=None, by_colour=False, late=True)[["video_id", "frame", "det_id", "y", "cx", "cy", "cv", "team", "by_colour", "late"]]


def live_video_teams(colours: DataFrame, net_y: float = NET_Y, frames: int = WARMUP_FRAMES, samples: int = WARMUP_SAMPLES, fps: float = FPS, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """video_teams() of a stream of colours (video_id, frame, det_id, y, cx, cy, cv), with late (boolean); a late row has no team."""
    rows = colours.select(*(F.col(c).cast("long").alias(c) for c in ("video_id", "frame", "det_id")), *(F.col(c).cast("double").alias(c) for c in ("y", "cx", "cy", "cv")))
    return in_order(rows, ["video_id"], _Colours(net_y, frames, samples), "video_id long, frame long, det_id long, y double, cx double, cy double, cv double, team string, by_colour boolean, late boolean", "frame", fps, lateness_ms)
