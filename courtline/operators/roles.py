"""Roles of players from how they move over a clip: attacker, setter, libero, defender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FPS
from ..functions import geometry as G
from ..functions.scalars import quantile

CLIP = ("match_id", "sequence")
#: The order of roles, zones in cm from the net, and thresholds.
ROLES = ("attacker", "setter", "libero", "defender")
SPEED_CAP, ATTACK_ZONE, NEAR_NET, BACK_ROW, LEAST_SEEN, LEAST_MARGIN = 800.0, 150.0, 160.0, 240.0, 0.4, 0.10


def slot_kinematics(moves: DataFrame, keys: tuple[str, ...] = CLIP, fps: float = FPS, side: str = "bottom") -> DataFrame:
    """Motion of each slot over a clip, from slot_velocity(); slots seen in under two frames have zeros and no distances."""
    net = G.net_distance(F.col("y"), side)
    vx, vy, v = F.col("vx") * fps, F.col("vy") * fps, F.col("speed") * fps
    ok = v <= SPEED_CAP
    toward = -vy if side == "bottom" else vy
    seen = F.count("x")
    q95 = lambda c: F.coalesce(quantile(F.when(ok, c), 0.95), F.lit(0.0))
    across, along = F.sum(F.abs("vx")), F.sum(F.abs("vy"))
    zero = lambda c: F.when(seen >= 2, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return moves.groupBy(*keys, "slot").agg(
        (seen / F.count("*")).alias("valid_frac"),
        F.when(seen >= 2, F.avg(net)).alias("net_dist_mean"),
        F.when(seen >= 2, F.min(net)).alias("net_dist_min"),
        zero(q95(v)).alias("vmax"),
        zero(q95(F.greatest(toward, F.lit(0.0)))).alias("approach_speed"),
        zero(q95(F.abs(vx))).alias("lateral_speed"),
        zero(F.when(across + along > 0, across / (across + along))).alias("lateral_ratio"),
        zero(F.sum(F.when(ok, F.col("speed")))).alias("displacement"),
    )


def slot_norm(c: str, keys: tuple[str, ...] = CLIP) -> Column:
    """Value over the largest one of the clip's slots; 0 if missing or nothing is above 0."""
    top = F.max(c).over(W.partitionBy(*keys))
    return F.when(top > 0, F.coalesce(F.col(c) / top, F.lit(0.0))).otherwise(0.0)


def role_scores(kin: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Score of each role for each slot; of setters and of liberos only the best of a clip keeps its score."""
    rows = kin.withColumn("a", slot_norm("approach_speed", keys)).withColumn("l", slot_norm("lateral_speed", keys)).withColumn("d", slot_norm("displacement", keys))
    usable = (F.col("valid_frac") >= LEAST_SEEN) & F.col("net_dist_mean").isNotNull()
    back = F.col("net_dist_mean") >= BACK_ROW
    raw = {
        "attacker": F.col("a") * F.when(F.col("net_dist_min") <= ATTACK_ZONE, 1.0).otherwise(0.4),
        "setter": F.when(F.col("net_dist_mean") <= NEAR_NET, 1.0).otherwise(0.2) * (1 - 0.8 * F.col("d")),
        "libero": F.when(back, 1.0).otherwise(0.1) * F.col("l") * (0.5 + 0.5 * F.col("lateral_ratio")),
        "defender": F.when(back, 0.7).otherwise(0.2) * (1 - 0.6 * F.col("a")),
    }
    rows = rows.withColumns({r: F.when(usable, c).otherwise(0.0) for r, c in raw.items()})
    best = lambda r: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(r), "slot")) == 1
    rows = rows.withColumns({f"__{r}": best(r) for r in ("setter", "libero")})
    return rows.withColumns({r: F.when(F.col(f"__{r}"), F.col(r)).otherwise(0.0) for r in ("setter", "libero")}).drop("a", "l", "d", "__setter", "__libero")


def infer_roles(moves: DataFrame, keys: tuple[str, ...] = CLIP, fps: float = FPS, side: str = "bottom") -> DataFrame:
    """Role of each slot of a clip; unknown if it is rarely seen, nothing scores, or two roles are close."""
    rows = role_scores(slot_kinematics(moves, keys, fps, side), keys)
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(F.col(r).alias("s"), F.lit(-k).alias("k"), F.lit(r).alias("role")) for k, r in enumerate(ROLES)))))
    rows = rows.withColumn("ranked", ranked).withColumn("margin", F.col("ranked")[0]["s"] - F.col("ranked")[1]["s"])
    unsure = (F.col("valid_frac") < LEAST_SEEN) | (F.col("ranked")[0]["s"] <= 0) | (F.col("margin") < LEAST_MARGIN)
    return rows.withColumn("role", F.when(unsure, "unknown").otherwise(F.col("ranked")[0]["role"])).drop("ranked")


def role_summary(roles: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Per clip: how many of each role, and the figures that describe them."""
    of = lambda r, c: F.when(F.col("role") == r, F.col(c))
    return roles.groupBy(*keys).agg(*(F.count(F.when(F.col("role") == r, 1)).alias(f"n_{r}") for r in (*ROLES, "unknown")), F.max("vmax").alias("max_vmax"), F.max(of("attacker", "approach_speed")).alias("attacker_approach"), F.max(of("libero", "lateral_speed")).alias("libero_lateral"), F.min(of("setter", "displacement")).alias("setter_displacement"))


def band_share(summary: DataFrame, low: float = 200.0, high: float = 400.0) -> DataFrame:
    """Share of clips whose attacker's speed lies in a range, and the mean."""
    rows = summary.where("attacker_approach is not null")
    return rows.agg(F.avg(F.col("attacker_approach").between(low, high).cast("double")).alias("share"), F.avg("attacker_approach").alias("mean"), F.count("*").alias("n_clips"))
