"""Measures of whole clips, augmentation, class names, smoothing and checks of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import COURT_W, FPS, STEP_CAP
from ..functions import geometry as G
from . import clean, frames, identity
from .stored import stored

CLIP = ("match_id", "sequence")


def reaction_lag(positions: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """reaction_lag_frames: from the ball's first turn to the peak speed of the player nearest to it then.

    Null without a ball, with fewer than three ball frames, without a turn, with no ball or player
    at the turn, or if that player never moves between two frames.
    """
    w, slot, clip = W.partitionBy(*keys, "slot").orderBy("frame_id"), W.partitionBy(*keys, "slot"), W.partitionBy(*keys)
    step = G.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    rows = positions.select(*keys, "frame_id", "slot", "x", "y", "ball_x", "ball_y").repartition(*keys)  # dealt by clip once
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("step", step)
    rows = rows.withColumn("peak", F.min_by(F.col("k") - 2, F.when(F.col("step").isNotNull(), F.struct(-F.col("step"), "k"))).over(slot))
    player = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("slot", "x", "y", "peak"))
    ball = rows.groupBy(*keys, "frame_id").agg(F.max("ball_x").alias("bx"), F.max("ball_y").alias("by"), F.collect_list(player).alias("players"))
    t = clip.orderBy("frame_id")
    ball = ball.withColumn("i", F.row_number().over(t) - 1).withColumn("dy", F.col("by") - F.lag("by").over(t)).withColumn("before", F.lag("dy").over(t))
    ball = ball.withColumn("n", F.count("by").over(clip)).withColumn("impact", F.min(F.when(F.col("before") * F.col("dy") <= 0, F.col("i") - 1)).over(clip))
    near = F.array_min(F.transform("players", lambda p: F.struct(G.distance(p["x"], p["y"], F.col("bx"), F.col("by")).alias("d"), p["slot"].alias("slot"), p["peak"].alias("peak"))))
    there = (F.col("i") == F.col("impact")) & (F.col("n") >= 3) & F.col("bx").isNotNull() & F.col("by").isNotNull()
    return ball.groupBy(*keys).agg(F.max(F.when(there, near["peak"] - F.col("impact"))).cast("double").alias("reaction_lag_frames"))


def clip_metrics(positions: DataFrame, keys: tuple[str, ...] = CLIP, gate: float = 120.0) -> DataFrame:
    """Ten measures of each clip on identity-repaired positions; gaps are not filled."""
    k = list(keys)
    positions = stored(positions, "positions")
    ball = positions.groupBy(*keys, "frame_id").agg(F.max("ball_x").alias("ball_x"), F.max("ball_y").alias("ball_y"))
    rows = stored(identity.recover_identity(positions, gate, keys).join(ball, [*k, "frame_id"]), "linked")  # read by every measure
    moved = frames.slot_velocity(rows, keys)
    speeds = frames.per_player_speed(moved, STEP_CAP, keys).groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list("speed_cm_s"))).alias("v"))
    top2 = G.mean_of(F.slice("v", 1, 2))
    rest = F.coalesce(G.mean_of(F.slice("v", 3, 6)), top2)
    speeds = speeds.select(*keys, F.coalesce(top2, F.lit(0.0)).alias("top2"), F.coalesce(rest, F.lit(0.0)).alias("rest"))
    d = frames.centroid_steps(frames.team_descriptor(clean.with_players(rows, (*keys, "frame_id"))), keys)
    many = F.when(F.col("n_present") >= 2, F.col("n_present"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    agg = d.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.avg("ball_present").alias("ball_present_frac"), zero(F.sum(F.col("nn_dist_mean") * many) / F.sum(many)).alias("spacing"), zero(F.avg(clean.cap_steps(F.col("centroid_step"))) * FPS).alias("centroid"), F.avg("hull_area").alias("hull"))
    sync = frames.sync_score(frames.kinematics(moved, (*keys, "frame_id")), keys)
    out = agg.join(speeds, k).join(sync, k).join(reaction_lag(rows, keys), k)
    ratio = F.when(F.col("rest") > 1e-6, F.col("top2") / F.col("rest")).otherwise(0.0)
    return out.select(*keys, "n_frames", "ball_present_frac", F.bround("top2", 1).alias("top2_speed_cms"), F.bround("rest", 1).alias("rest_speed_cms"), F.bround(ratio, 2).alias("speed_ratio"), F.bround("spacing", 1).alias("mean_spacing_cm"), F.bround("centroid", 1).alias("centroid_vel_cms"), F.bround("sync_score", 3).alias("sync_score"), F.bround("hull").alias("mean_hull_area"), "reaction_lag_frames")


def uniform(key: Column, part: int = 0) -> Column:
    """A number in [0, 1) that depends on the key's text alone: 32 bits of its MD5 (parts 0 to 3)."""
    return F.conv(F.substring(F.md5(key), 8 * part + 1, 8), 16, 10).cast("double") / float(1 << 32)


def gaussian_pair(key: Column) -> tuple[Column, Column]:
    """Two independent standard normal numbers of a key (Box and Muller)."""
    far, turn = F.sqrt(-2 * F.log(1 - uniform(key, 0))), 2 * pi * uniform(key, 1)
    return far * F.cos(turn), far * F.sin(turn)


def augment(positions: DataFrame, keys: tuple[str, ...] = CLIP, jitter: float = 15.0, mirror: float = 0.5, seed: int = 7) -> DataFrame:
    """Present points moved by Gaussian noise of ``jitter`` cm, and whole clips mirrored left to right by a coin of their key.

    Noise comes from hashes of clip, frame and slot (the ball's of clip and frame), so it is the same however rows
    are dealt or sorted, and when a task runs again.
    """
    text = lambda *more: F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys), *more)
    own, ball = gaussian_pair(text(F.col("frame_id"), F.col("slot"))), gaussian_pair(text(F.col("frame_id"), F.lit("ball")))
    out = positions.withColumn("mirrored", uniform(text()) < mirror)
    out = out.withColumns({c: F.col(c) + jitter * noise for c, noise in zip(("x", "y", "ball_x", "ball_y"), (*own, *ball), strict=True)})
    return out.withColumns({c: F.when(F.col("mirrored"), COURT_W - F.col(c)).otherwise(F.col(c)) for c in ("x", "ball_x")})


def class_filter(clips: DataFrame, known: Sequence[str], remap: Mapping[str, str] | None = None, label: str = "label") -> DataFrame:
    """Clips with a known label, after an optional renaming."""
    name = F.col(label)
    if remap:
        name = F.coalesce(F.create_map(*(F.lit(x) for kv in remap.items() for x in kv))[name], name)
    return clips.withColumn(label, name).where(F.col(label).isin(*known))


#: Names of person classes.
PERSON_NAMES = ("person", "player", "players", "people", "human", "athlete")


def resolve_classes(classes: DataFrame, person: int | None = None, ball: int | None = None) -> DataFrame:
    """person_id and ball_id of each model (model, id, name): given, else by name (the least id), else the only class is the person, whatever it is called."""
    name = F.lower(F.trim("name"))
    own = classes.groupBy("model").agg(F.min(F.when(name.isin(*PERSON_NAMES), F.col("id"))).alias("p"), F.min(F.when(name.contains("ball"), F.col("id"))).alias("b"), F.count("*").alias("n"), F.min("id").alias("first"))
    only = F.when(F.col("n") == 1, F.col("first"))
    return own.select("model", F.coalesce(F.lit(person).cast("long"), F.col("p"), only).alias("person_id"), F.coalesce(F.lit(ball).cast("long"), F.col("b")).alias("ball_id"))


def smoothed(value: Column, keep: float, w, first_whole: bool = True, taps: int = 130) -> Column:
    """Exponential moving average over the rows of a window, as a weighted sum of its last ``taps`` values.

    The window's rows must all have a value. The first value counts in full, or from zero without ``first_whole``.
    """
    past = F.collect_list(value).over(w.rowsBetween(-taps, 0))
    place = F.count(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    n = F.size(past)
    weight = lambda i: F.pow(F.lit(keep), (n - 1 - i).cast("double"))
    whole = (lambda i: F.when((i == 0) & (place == n), 1.0).otherwise(1 - keep)) if first_whole else (lambda i: F.lit(1 - keep))
    return F.aggregate(F.transform(past, lambda v, i: v * weight(i) * whole(i)), F.lit(0.0), lambda s, v: s + v)


def smoothed_hits(rows: DataFrame, value: str, keep: float, keys: Sequence[str], order: str = "frame_id") -> DataFrame:
    """Adds ema: the average of the values so far, unchanged where ``value`` is missing and null before the first."""
    hit = F.col(value).isNotNull()
    own = W.partitionBy(*keys, "__hit").orderBy(order)
    rows = rows.withColumn("__hit", hit)
    rows = rows.withColumn("__ema", F.when(F.col("__hit"), smoothed(F.col(value), keep, own)))
    last = F.last("__ema", ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("ema", last).drop("__hit", "__ema")


def onset(state: Column, w) -> Column:
    """True where a state holds and did not in the row before."""
    return state & ~F.lag(state, 1, False).over(w)


def checks(results: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(name, ok, n) of claims: each is a table and a condition that all its rows must meet."""
    parts = [df.agg(F.lit(name).alias("name"), F.coalesce(F.bool_and(F.coalesce(F.expr(condition), F.lit(False))), F.lit(False)).alias("ok"), F.count("*").alias("n")) for name, df, condition in results]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
