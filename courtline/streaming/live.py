"""Live forms of the windows and folds: event time from frame numbers, late rows aside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import FPS, WINDOW
from ..operators.identity import ball_velocity

#: How late a frame may come.
LATENESS = "2 seconds"


def with_event_time(frames: DataFrame, fps: float = FPS, frame: str = "frame") -> DataFrame:
    """Adds ts, the match's start plus the frame's time, with a watermark; repeated detections are dropped."""
    ts = F.timestamp_micros((F.col(frame) * int(1_000_000 / fps)).cast("long"))
    out = frames.withColumn("ts", ts).withWatermark("ts", LATENESS)
    keys = [c for c in ("video_id", frame, "det_id") if c in frames.columns]
    return out.dropDuplicatesWithinWatermark(keys)


def count_windows(frames: DataFrame, size: int = WINDOW, fps: float = FPS, frame: str = "frame") -> DataFrame:
    """Windows of ``size`` frames of each video with how many frames they have, once the watermark passed them.

    The window follows from the frame's number, so a missing frame shortens its own window only.
    """
    step = int(1_000_000 / fps)
    rows = with_event_time(frames, fps, frame).withColumn("sequence", F.floor((F.col(frame) - 1) / size).cast("long"))
    span = f"{size * step} microseconds"
    return rows.groupBy("video_id", F.window("ts", span, span, f"{step} microseconds"), "sequence").agg(F.count("*").alias("n_frames")).select("video_id", "sequence", "n_frames", (F.col("n_frames") == size).alias("whole"))


def label_counts(windows: DataFrame) -> DataFrame:
    """Running counts per label and of anomalies (output mode update or complete)."""
    return windows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("anomaly").cast("long")).alias("n_anomalies"))


def live_ball(frames: DataFrame, most: int = 12, alpha: float = 0.55) -> DataFrame:
    """Ball of every frame of a stream (video_id, frame, ball_x, ball_y) with predictions in short gaps.

    State per video is the last frame, the last sighting and the velocity there. Frames of a batch
    are taken in order; a frame at or before the last one seen comes too late and is marked so.
    """
    schema = "video_id long, frame long, ball_x double, ball_y double, predicted boolean, late boolean"

    def fold(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        last, *before = kept.get if kept.exists else (-1, None, None, None, None, None)
        rows = pd.concat(list(parts)).sort_values("frame")
        frame, x, y = (rows[c].to_numpy(float) for c in ("frame", "ball_x", "ball_y"))
        late = frame <= last
        late[1:] |= frame[1:] == frame[:-1]
        seen = ~late & ~np.isnan(x) & ~np.isnan(y)
        at, sx, sy = frame[seen], x[seen], y[seen]
        if before[0] is not None:  # the last sighting of the batches before stands first
            at, sx, sy = (np.r_[b, v] for b, v in zip(before[:3], (at, sx, sy), strict=True))
        if len(at):
            v = ball_velocity(at, sx, sy, most, alpha, (before[3], before[4]) if before[0] is not None else (0.0, 0.0))
            place = np.searchsorted(at, frame, side="right") - 1
            m = np.where(place >= 0, frame - at[place], np.inf)
            on = ~late & ~seen & (m <= most)
            x, y = (np.where(on, p[place] + v[place, a] * np.where(on, m, 0), c) for a, (p, c) in enumerate(((sx, x), (sy, y))))
            before = [int(at[-1]), float(sx[-1]), float(sy[-1]), float(v[-1, 0]), float(v[-1, 1])]
        else:
            on = np.zeros(len(frame), bool)
        gone = ~late & ~seen & ~on
        kept.update((int(max(last, frame.max())), *before))
        yield pd.DataFrame({"video_id": key[0], "frame": rows["frame"].to_numpy(), "ball_x": np.where(gone, np.nan, x), "ball_y": np.where(gone, np.nan, y), "predicted": on, "late": late})

    state = "last long, frame long, x double, y double, vx double, vy double"
    return frames.select(F.col("video_id").cast("long"), F.col("frame").cast("long"), "ball_x", "ball_y").groupBy("video_id").applyInPandasWithState(fold, schema, state, "append", GroupStateTimeout.NoTimeout)
