"""Projection to the court, model sequences, and verdicts of windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import COURT_H, COURT_W, FRAME_CHANNELS, KINEMATIC_CHANNELS, NET_Y, WINDOW
from ..functions import geometry as G
from . import clean, clips, frames, identity, rules, scan

CLIP = ("match_id", "sequence")


def solve_homography(corners: np.ndarray, half: bool) -> np.ndarray:
    """Nine coefficients that map four corners (top left, top right, bottom right, bottom left) to the court, or to its near half."""
    top = NET_Y if half else 0.0
    target = np.array([(0.0, top), (COURT_W, top), (COURT_W, COURT_H), (0.0, COURT_H)])
    a, b = np.zeros((8, 8)), target.reshape(-1)
    for k, ((x, y), (u, v)) in enumerate(zip(corners, target, strict=True)):
        a[2 * k] = (x, y, 1, 0, 0, 0, -u * x, -u * y)
        a[2 * k + 1] = (0, 0, 0, x, y, 1, -v * x, -v * y)
    try:
        return np.append(np.linalg.solve(a, b), 1.0)
    except np.linalg.LinAlgError:
        return np.full(9, np.nan)


def homography_fit(calibrations: DataFrame) -> DataFrame:
    """Adds h to a small table of calibrations (corners: four points in any order, half: boolean); null for degenerate corners."""

    @F.pandas_udf("array<double>")
    def fit(flat: pd.Series, half: pd.Series) -> pd.Series:
        solved = [solve_homography(np.asarray(c, float).reshape(4, 2), bool(h)) for c, h in zip(flat, half, strict=True)]
        return pd.Series([None if np.isnan(h).any() else h.tolist() for h in solved])

    ordered = G.order_corners(F.col("corners"))
    flat = F.flatten(F.transform(ordered, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    return calibrations.withColumn("h", fit(flat, F.coalesce("half", F.lit(False))))


def court_mask(dets: DataFrame, calibrations: DataFrame, margin: float = 12.0) -> DataFrame:
    """Person detections whose foot is inside the court's quad or within ``margin`` pixels; without a quad all stay.

    dets: video_id, frame, x1..y2; calibrations: video_id, corners (one per video; see
    calibration_asof() for several).
    """
    foot = G.foot_point(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    both = dets.join(calibrations.select("video_id", "corners"), "video_id", "left").withColumn("foot", foot)
    inside = G.quad_signed_distance(F.col("foot.x"), F.col("foot.y"), F.col("corners")) >= -margin
    return both.where(F.col("corners").isNull() | inside).drop("corners", "foot")


def to_court(px: Column, py: Column, h: Column, width: Column, height: Column) -> Column:
    """Court centimetres by the homography, or by the frame's size where there is none."""
    return F.when(h.isNotNull(), G.apply_homography(h, px, py)).otherwise(G.linear_scale(px, py, width, height))


def positions_from_tracks(tracks: DataFrame, calibrations: DataFrame, max_gap: int = 15) -> DataFrame:
    """Tracked boxes to court positions in six slots: video_id, frame, slot, x, y.

    calibrations: video_id, h, frame_w, frame_h.
    """
    foot = G.foot_point(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    both = tracks.join(calibrations.select("video_id", "h", "frame_w", "frame_h"), "video_id", "left").withColumn("foot", foot)
    at = to_court(F.col("foot.x"), F.col("foot.y"), F.col("h"), F.col("frame_w"), F.col("frame_h"))
    placed = both.where("track_id is not null").select("video_id", "frame", "track_id", at.alias("p")).select("video_id", "frame", "track_id", "p.x", "p.y")
    return identity.manage_slots(placed.dropDuplicates(["video_id", "frame", "track_id"]), max_gap).drop("track_id")


def camera_chain(frames_: DataFrame, chunk: int = scan.CHUNK) -> DataFrame:
    """Corners of every frame: those detected, else the last ones moved by the frame's affine map, else unchanged.

    frames_: video_id, frame, corners (eight numbers or null), affine (six numbers or null); one row a
    frame. The chain is a prefix scan of maps that fix or move the corners; frames before the
    first detection have none.
    """
    number = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    fixed = F.col("corners").isNotNull()
    step = F.concat(F.coalesce(F.col("corners").cast("array<double>"), F.array_repeat(F.lit(0.0), 8)), F.coalesce(F.col("affine").cast("array<double>"), number(1, 0, 0, 0, 1, 0)), F.array(fixed.cast("double")))
    kind = dict(frames_.dtypes)["frame"]
    out = scan.prefix_scan(frames_.select(F.col("video_id").alias("key"), F.col("frame").alias("at"), step.alias("map")), scan.moved, chunk)
    return out.select(F.col("key").alias("video_id"), F.col("at").cast(kind).alias("frame"), F.when(F.get("map", F.lit(14)) > 0, F.slice("map", 1, 8)).alias("corners"))


def model_sequence(positions: DataFrame, keys: tuple[str, ...] = CLIP, size: int = WINDOW, dealt: bool = False) -> DataFrame:
    """Eighteen channels for each of ``size`` frames of a clip: identity, gaps of players and ball filled, descriptor, padding.

    The ball goes along with the players, so positions (dealt: by clip already) are read once and nothing is joined.
    """
    k = [*keys, "frame_id"]
    positions = positions.na.drop(subset=k)
    ball = {c: F.max(c).over(W.partitionBy(*k)) for c in ("ball_x", "ball_y")}
    rows = identity.recover_identity((positions if dealt else positions.repartition(*keys)).withColumns(ball), keys=keys, carried=("ball_x", "ball_y"), dealt=True).repartition(*keys)
    rows = frames.interpolate_gaps(rows, keys=keys).drop("filled")
    # every slot has every frame, so the ball's gaps are those of each slot
    turn = lambda df: df.select(*k, "slot", F.col("ball_x").alias("x"), F.col("ball_y").alias("y"), F.col("x").alias("ball_x"), F.col("y").alias("ball_y"))
    rows = turn(frames.interpolate_gaps(turn(rows), keys=keys))
    return clips.pad_windows(frames.frame_channels(rows, keys, dealt=True).select(*k, *FRAME_CHANNELS, *KINEMATIC_CHANNELS), size, keys)


def window_verdicts(raw: DataFrame, keys: tuple[str, ...] = CLIP, size: int = WINDOW, scored: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Label of each whole window: unclassified while the ball is dead, else by the model, else by the rules.

    scored: keys, label, confidence, entropy, entropy_norm, is_anomaly and probs of a model, one row a window; a window
    without a row (or all, without ``scored``) goes by the rules. by tells who decided: gate, model or rules. Gate and
    rules are sure (confidence 1, entropy 0, no anomaly, no probs). dealt: raw is dealt by keys already; gate and rules then share that.
    """
    rows = frames.whole_windows(raw if dealt else raw.repartition(*keys), size, keys)
    gate = frames.activity_gate(frames.slot_velocity(clean.clean_positions(rows), keys), keys)
    labels = rules.label_clips(rows, keys).select(*keys, F.col("label").alias("by_rules"))
    out = gate.join(labels, list(keys))
    if scored is None:
        return out.select(*keys, "dead_ball", F.when(F.col("dead_ball"), "Unclassified").otherwise(F.col("by_rules")).alias("label"))
    told = ("confidence", "entropy", "entropy_norm", "is_anomaly", "probs")
    out = out.join(scored.select(*keys, F.col("label").alias("by_model"), *told), list(keys), "left")
    by = F.when(F.col("dead_ball"), "gate").when(F.col("by_model").isNotNull(), "model").otherwise("rules")
    sure = {"confidence": F.lit(1.0), "entropy": F.lit(0.0), "entropy_norm": F.lit(0.0), "is_anomaly": F.lit(False)}
    label = F.when(F.col("by") == "gate", "Unclassified").when(F.col("by") == "model", F.col("by_model")).otherwise(F.col("by_rules"))
    own = F.col("by") == "model"
    out = out.withColumn("by", by)
    return out.select(*keys, "dead_ball", "by", label.alias("label"), *(F.when(own, F.col(c)).otherwise(v).alias(c) for c, v in sure.items()), F.when(own, F.col("probs")).alias("probs"))
