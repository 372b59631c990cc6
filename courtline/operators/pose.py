"""Jumps and arm swings from keypoints: one row per tracked skeleton and frame.

keypoints: video_id, frame, track_id, box (x1, y1, x2, y2) and kp, an array of seventeen x, y, conf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import box_iou
from ..functions.scalars import wrap_angle
from .measures import smoothed
from .stored import stored

#: Places of shoulders, wrists and hips among the keypoints, and thresholds.
SHOULDERS, WRISTS, HIPS = (5, 6), (9, 10), (11, 12)
SURE, HEIGHT_M, JUMP, SWING = 0.3, 1.85, 1.8, 12.0


def hip_height(kp: Column) -> Column:
    """Mean y of the hips that are sure; null without one."""
    sure = F.filter(F.array(*(kp[i] for i in HIPS)), lambda p: p["conf"] >= SURE)
    return F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(sure))


def arm_angle(kp: Column) -> Column:
    """Angle from shoulder to wrist of the surer arm; null if neither is sure."""
    left, right = (F.least(kp[s]["conf"], kp[w]["conf"]) for s, w in zip(SHOULDERS, WRISTS, strict=True))
    angle = lambda k: F.atan2(kp[WRISTS[k]]["y"] - kp[SHOULDERS[k]]["y"], kp[WRISTS[k]]["x"] - kp[SHOULDERS[k]]["x"])
    return F.when((left >= SURE) & (left >= right), angle(0)).when(right >= SURE, angle(1))


def pose_motion(keypoints: DataFrame, fps: float = 30.0, alpha: float = 0.5, chunk: int = 4096) -> DataFrame:
    """vy_ms, arm_omega_rad_s, airborne, takeoff and impact of each skeleton, against the track's row before.

    The vertical speed is smoothed from zero over the rows in which both hips are known, and is 0
    in the others. A track is cut into chunks of frames, and a row for each chunk tells the next ones how it
    ended, so no window over rows holds more of a track than a chunk.
    """
    keys = ["video_id", "track_id"]
    own = [*keys, "__chunk"]
    at = F.floor(F.col("frame") / chunk).cast("long").alias("__chunk")
    rows = keypoints.select("video_id", "frame", "track_id", at, F.greatest(F.col("box.y2") - F.col("box.y1"), F.lit(1.0)).alias("h"), hip_height(F.col("kp")).alias("hip"), arm_angle(F.col("kp")).alias("angle"))
    rows = stored(rows, "poses")
    w, chunks = W.partitionBy(*own).orderBy("frame"), W.partitionBy(*keys).orderBy("__chunk")

    def joined(rows: DataFrame, ends: DataFrame) -> DataFrame:
        ends = ends.withColumnsRenamed({c: f"{c}_of" for c in own})
        return rows.join(ends, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in own)), "left").drop(*(f"{c}_of" for c in own))

    # the row before, which may be the last one of a chunk before
    ends = rows.groupBy(*own).agg(F.max_by(F.struct("hip", "angle"), "frame").alias("end"))
    rows = joined(rows, ends.select(*own, F.lag("end").over(chunks).alias("__end")))
    first = F.row_number().over(w) == 1
    before = lambda c: F.when(first, F.col("__end")[c]).otherwise(F.lag(c).over(w))
    raw = -(F.col("hip") - before("hip")) * (HEIGHT_M / F.col("h")) * fps
    omega = F.abs(wrap_angle(F.col("angle") - before("angle"))) * fps
    rows = rows.withColumn("raw", raw).withColumn("arm_omega_rad_s", F.coalesce(omega, F.lit(0.0))).withColumn("known", F.col("raw").isNotNull())
    # the average within a chunk, from zero, and what is left of that of the chunks before
    steps = W.partitionBy(*own, "known").orderBy("frame")
    rows = rows.withColumn("ema", F.when(F.col("known"), smoothed(F.col("raw"), 1 - alpha, steps, first_whole=False, taps=60)))
    rows = stored(rows.withColumn("n", F.count("raw").over(w)).drop("__end", "hip", "angle", "h"), "motion")
    fade = lambda n: F.pow(F.lit(1 - alpha), n.cast("double"))
    ends = rows.groupBy(*own).agg(F.max("n").alias("n"), F.max_by("ema", F.when(F.col("known"), F.col("frame"))).alias("ema"), F.max_by("known", "frame").alias("known"))
    past = F.collect_list(F.when(F.col("n") > 0, F.struct("ema", "n"))).over(chunks.rowsBetween(-60, -1))
    ends = ends.withColumn("__before", F.aggregate(past, F.lit(0.0), lambda s, c: c["ema"] + s * fade(c["n"])))
    flying = F.col("known") & (F.col("ema") + F.col("__before") * fade(F.col("n")) > JUMP)
    rows = joined(rows, ends.select(*own, "__before", F.coalesce(F.lag(flying).over(chunks), F.lit(False)).alias("__flying")))
    rows = rows.withColumn("vy_ms", F.when(F.col("known"), F.col("ema") + F.col("__before") * fade(F.col("n"))).otherwise(0.0)).withColumn("airborne", F.col("vy_ms") > JUMP)
    flew = F.when(F.row_number().over(w) == 1, F.col("__flying")).otherwise(F.lag("airborne").over(w))
    return rows.select("video_id", "frame", "track_id", "vy_ms", "arm_omega_rad_s", "airborne", (F.col("airborne") & ~flew).alias("takeoff"), (F.col("arm_omega_rad_s") > SWING).alias("impact"))


def pose_frames(motion: DataFrame) -> DataFrame:
    """Per frame: largest upward speed, mean absolute speed, largest arm speed and how many are airborne."""
    return motion.groupBy("video_id", "frame").agg(F.greatest(F.max("vy_ms"), F.lit(0.0)).alias("max_vy_up"), F.avg(F.abs("vy_ms")).alias("mean_abs_vy"), F.max("arm_omega_rad_s").alias("max_arm_omega"), F.count(F.when(F.col("airborne"), 1)).alias("n_airborne"))


def pose_events(motion: DataFrame) -> DataFrame:
    """Take-offs and arm swings as rows."""
    kinds = F.array(F.when(F.col("takeoff"), F.struct(F.lit("jump_takeoff").alias("event"), F.col("vy_ms").alias("value"))), F.when(F.col("impact"), F.struct(F.lit("arm_swing_impact").alias("event"), F.col("arm_omega_rad_s").alias("value"))))
    return motion.select("video_id", "frame", "track_id", F.inline(F.filter(kinds, lambda e: e.isNotNull())))


def match_skeletons(tracks: DataFrame, skeletons: DataFrame, least: float = 0.3) -> DataFrame:
    """One-to-one pairs of tracks (track_id) and skeletons (skeleton_id) of a frame: video_id, frame, track_id, skeleton_id, iou.

    Both have video_id, frame and a box. Pairs overlapping by ``least`` or more are taken best first, of
    equal ones that of the larger ids; a track or skeleton that is taken is out. A frame's candidates are
    one short array.
    """
    box = F.struct("x1", "y1", "x2", "y2")
    a = tracks.select("video_id", "frame", "track_id", box.alias("a"))
    b = skeletons.select("video_id", "frame", "skeleton_id", box.alias("b"))
    near = a.join(b, ["video_id", "frame"]).select("video_id", "frame", "track_id", "skeleton_id", box_iou(F.col("a"), F.col("b")).alias("iou")).where(F.col("iou") >= least)
    ranked = near.groupBy("video_id", "frame").agg(F.sort_array(F.collect_list(F.struct("iou", "track_id", "skeleton_id")), asc=False).alias("all"))
    free = lambda got, c: ~F.exists(got, lambda g: (g["track_id"] == c["track_id"]) | (g["skeleton_id"] == c["skeleton_id"]))
    taken = F.aggregate("all", F.filter("all", lambda _: F.lit(False)), lambda got, c: F.when(free(got, c), F.concat(got, F.array(c))).otherwise(got))
    return ranked.select("video_id", "frame", F.inline(taken)).select("video_id", "frame", "track_id", "skeleton_id", "iou")
