"""Formation and movement descriptors of frames, windows and clips.

Movement takes steps from one frame to the next inside a clip; on a dense grid of frames a
missing player makes the steps next to it null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FPS, WINDOW
from ..functions import geometry as G

CLIP = ("match_id", "sequence")


def team_descriptor(frames: DataFrame) -> DataFrame:
    """Fourteen order-free channels per frame from ``players`` and the ball; no shuffle, no Python."""
    p, n = F.col("players"), F.size("players")
    mean = lambda axis: G.mean_of(F.transform(p, lambda q: q[axis]))
    has_ball = F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()
    cx, cy = F.col("cx"), F.col("cy")

    def spread(axis: str, centre: Column) -> Column:
        return F.when(n > 1, F.sqrt(G.mean_of(F.transform(p, lambda q: (q[axis] - centre) * (q[axis] - centre))))).otherwise(0.0)

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    near = F.col("near")
    out = frames.withColumn("cx", mean("x")).withColumn("cy", mean("y")).withColumn("near", F.when(n >= 2, G.nearest_distances(p)))
    return out.select(
        *[c for c in frames.columns if c not in ("players", "ball_x", "ball_y")],
        has_ball.cast("double").alias("ball_present"),
        zero(F.when(has_ball, F.col("ball_x"))).alias("ball_x"),
        zero(F.when(has_ball, F.col("ball_y"))).alias("ball_y"),
        zero(cx).alias("centroid_x"),
        zero(cy).alias("centroid_y"),
        spread("x", cx).alias("spread_x"),
        spread("y", cy).alias("spread_y"),
        G.hull_area(p).alias("hull_area"),
        zero(G.mean_of(near)).alias("nn_dist_mean"),
        zero(F.array_min(near)).alias("nn_dist_min"),
        zero(F.array_max(near)).alias("nn_dist_max"),
        zero(F.when(n >= 2, F.array_max(G.pair_distances(p)))).alias("max_pair_dist"),
        n.cast("double").alias("n_present"),
        zero(F.when(has_ball, G.distance(cx, cy, F.col("ball_x"), F.col("ball_y")))).alias("ball_to_centroid"),
    )


def slot_velocity(positions: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Adds vx, vy and speed (per frame) of each slot's step from the frame before; null at either gap."""
    w = W.partitionBy(*keys, "slot").orderBy("frame_id")
    step = F.lag("frame_id").over(w) == F.col("frame_id") - 1
    out = positions.withColumn("vx", F.when(step, F.col("x") - F.lag("x").over(w))).withColumn("vy", F.when(step, F.col("y") - F.lag("y").over(w)))
    return out.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))


def _unit_pairs(movers: Column) -> Column:
    """Cosines of all pairs of velocities (slot, vx, vy)."""
    cosine = lambda a, b: (a["vx"] * b["vx"] + a["vy"] * b["vy"]) / (a["speed"] * b["speed"])
    return F.flatten(F.transform(movers, lambda a: F.transform(F.filter(movers, lambda b: b["slot"] > a["slot"]), lambda b: cosine(a, b))))


def _movers() -> Column:
    """Moving slots of a frame, the fastest first (an aggregate of rows with velocities)."""
    return F.reverse(F.array_sort(F.collect_list(F.when(F.col("speed").isNotNull(), F.struct("speed", "slot", "vx", "vy")))))


def _movement(rows: DataFrame) -> DataFrame:
    """Replaces m (movers) by speed_top2, speed_bot4, sync_inst, n_pairs, sum_cos and speed_diff."""
    speeds = F.transform("m", lambda q: q["speed"])
    cosines = _unit_pairs(F.filter("m", lambda q: q["speed"] >= 1e-6))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows.select(*(c for c in rows.columns if c != "m"), zero(G.mean_of(F.slice(speeds, 1, 2))).alias("speed_top2"), zero(G.mean_of(F.slice(speeds, 3, 4))).alias("speed_bot4"), zero(G.mean_of(cosines)).alias("sync_inst"), F.size(cosines).alias("n_pairs"), F.aggregate(cosines, F.lit(0.0), lambda s, v: s + v).alias("sum_cos"))
    return out.withColumn("speed_diff", F.col("speed_top2") - F.col("speed_bot4"))


def kinematics(moves: DataFrame, keys: tuple[str, ...] = (*CLIP, "frame_id")) -> DataFrame:
    """speed_top2, speed_bot4, speed_diff and sync_inst per frame, from slot_velocity(); 0 where nothing moves."""
    return _movement(moves.groupBy(*keys).agg(_movers().alias("m")))


def frame_channels(positions: DataFrame, keys: tuple[str, ...] = CLIP, dealt: bool = False) -> DataFrame:
    """All channels of each frame: team_descriptor() and kinematics() in one pass over clean positions.

    Rows are dealt by clip once (dealt: they are already); steps, frames and whatever is taken per clip afterwards need no other shuffle.
    """
    player = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("slot", "x", "y"))
    moved = slot_velocity(positions if dealt else positions.repartition(*keys), keys)
    rows = moved.groupBy(*keys, "frame_id").agg(F.max("ball_x").alias("ball_x"), F.max("ball_y").alias("ball_y"), F.array_sort(F.collect_list(player)).alias("players"), _movers().alias("m"))
    return _movement(team_descriptor(rows))


def sync_score(kin: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """One mean over all pairs of all frames of a clip; 0 without pairs."""
    return kin.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum("sum_cos"), F.sum("n_pairs")), F.lit(0.0)).alias("sync_score"))


def centroid_steps(descriptors: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Adds the step of the centroid from the frame before; null where a frame has no player."""
    w = W.partitionBy(*keys).orderBy("frame_id")
    there = (F.col("n_present") > 0) & (F.lag("n_present").over(w) > 0) & (F.lag("frame_id").over(w) == F.col("frame_id") - 1)
    step = G.distance(F.col("centroid_x"), F.col("centroid_y"), F.lag("centroid_x").over(w), F.lag("centroid_y").over(w))
    return descriptors.withColumn("centroid_step", F.when(there, step))


def window_metrics(channels: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Per window, from frame_channels(): synchrony, spacing, centroid speed, spatial variance and speeds of the fast and the rest."""
    rows = centroid_steps(channels, keys)
    first = F.col("frame_id") > F.min("frame_id").over(W.partitionBy(*keys))
    rows = rows.withColumn("later", first).withColumn("variance", F.when(F.col("n_present") >= 2, F.col("spread_x") * F.col("spread_x") + F.col("spread_y") * F.col("spread_y"))).withColumn("spaced", F.when(F.col("n_present") >= 2, F.col("n_present")))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_frames"),
        F.coalesce(F.try_divide(F.sum("sum_cos"), F.sum("n_pairs")), F.lit(0.0)).alias("sync_score"),
        F.coalesce(F.try_divide(F.sum(F.col("nn_dist_mean") * F.col("spaced")), F.sum("spaced")), F.lit(0.0)).alias("mean_spacing_cm"),
        mean(F.col("centroid_step")).alias("centroid_vel_cm_per_frame"),
        mean(F.col("variance")).alias("var_spatial_cm2"),
        mean(F.when(F.col("later"), F.col("speed_top2"))).alias("speed_top2_cm_frame"),
        mean(F.when(F.col("later"), F.col("speed_bot4"))).alias("speed_bot4_cm_frame"),
    )
    return out.withColumn("speed_diff_cm_frame", F.col("speed_top2_cm_frame") - F.col("speed_bot4_cm_frame"))


def per_player_speed(moves: DataFrame, cap: float = 50.0, keys: tuple[str, ...] = CLIP, fps: float = FPS) -> DataFrame:
    """Mean speed in cm/s of each slot over a clip, steps over the cap left out."""
    return moves.groupBy(*keys, "slot").agg((F.avg(F.when(F.col("speed") <= cap, F.col("speed"))) * fps).alias("speed_cm_s"))


def interpolate_gaps(positions: DataFrame, most: int = 15, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Fill inner gaps of up to ``most`` frames of each slot linearly; edges and longer gaps stay null."""
    w = W.partitionBy(*keys, "slot").orderBy("frame_id")
    here = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(F.col("frame_id").alias("f"), F.col("x").alias("x"), F.col("y").alias("y")))
    a, b = F.col("__a"), F.col("__b")
    out = positions.withColumn("__a", F.last(here, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__b", F.first(here, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    fills = F.col("x").isNull() & a.isNotNull() & b.isNotNull() & (b["f"] - a["f"] - 1 <= most)
    at = lambda c: F.when(fills, a[c] + (b[c] - a[c]) * (F.col("frame_id") - a["f"]) / (b["f"] - a["f"])).otherwise(F.col(c))
    return out.withColumns({"x": at("x"), "y": at("y"), "filled": fills}).drop("__a", "__b")


def whole_windows(df: DataFrame, size: int = WINDOW, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Rows of windows that have all their frames; a trailing part of a window is dropped."""
    w = W.partitionBy(*keys)
    place = F.when(F.col("frame_id").isNotNull(), F.dense_rank().over(w.orderBy(F.asc_nulls_last("frame_id"))))
    rows = df.withColumn("__place", place).withColumn("__n", F.max("__place").over(w))
    return rows.where(F.col("__n") == size).na.drop(subset=list(keys)).drop("__place", "__n")


def activity_gate(moves: DataFrame, keys: tuple[str, ...] = CLIP, least_speed: float = 2.0, least_players: float = 3.0) -> DataFrame:
    """Per window: mean step of all players, mean number present, and whether the ball is dead."""
    out = moves.groupBy(*keys).agg(F.coalesce(F.avg("speed"), F.lit(0.0)).alias("gate_mean_speed_cm_frame"), (F.count("x") / F.count_distinct("frame_id")).alias("gate_players_present"))
    return out.withColumn("dead_ball", (F.col("gate_mean_speed_cm_frame") < least_speed) | (F.col("gate_players_present") < least_players))
