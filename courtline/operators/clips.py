"""Features of clips: statistics of frame channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FRAME_CHANNELS, KINEMATIC_CHANNELS, WINDOW
from ..functions.scalars import ratio_clip, slope

CLIP = ("match_id", "sequence")
MODEL_CHANNELS = FRAME_CHANNELS + KINEMATIC_CHANNELS
#: Scale-free ratios of channels, and channels that have no scale.
RATIOS = {"compactness": ("nn_dist_mean", "max_pair_dist"), "tightest_pair": ("nn_dist_min", "nn_dist_mean"), "loosest_pair": ("nn_dist_max", "nn_dist_mean"), "spread_aspect": ("spread_x", "spread_y"), "ball_offset": ("ball_to_centroid", "max_pair_dist"), "speed_ratio": ("speed_top2", "speed_bot4"), "speed_diff_share": ("speed_diff", "speed_top2")}
DIMENSIONLESS = ("n_present", "sync_inst", "ball_present")
STATS = ("mean", "std", "min", "max", "slope", "iqr")
#: Statistics of z-scored channels; their mean and spread are 0 and 1 always.
SHAPES = ("min", "max", "slope", "iqr")
MODES = ("absolute", "invariant", "both")


def speed_ranks(moves: DataFrame, keys: tuple[str, ...] = (*CLIP, "frame_id")) -> DataFrame:
    """Rank of each moving slot by speed within its frame, the fastest first."""
    return moves.where("speed is not null").select(*keys, "slot", "speed", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("speed"), "slot")).cast("long").alias("rank"))


def channels(frames: DataFrame, names: Sequence[str], keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Frame rows in long form: keys, frame_id, channel, v."""
    cells = F.array(*(F.struct(F.lit(n).alias("channel"), F.col(n).cast("double").alias("v")) for n in names))
    return frames.select(*keys, "frame_id", F.inline(cells))


#: Steps of a channel whose statistics are taken in whole numbers, and the most that such sums may reach.
_STEPS, _MOST = 4, 2.0**31


def _mean(v: Column) -> Column:
    """Mean that does not depend on the order of rows: what is above a millionth is added without an error."""
    high = F.rint(v * 2.0**20) / 2.0**20
    return (F.sum(high) + F.sum(v - high)) / F.count(v)


def _statistics(frames: DataFrame, names: Sequence[str], keys: tuple[str, ...]) -> DataFrame:
    """keys and stats, an array of (channel, mean, std, min, max, slope, iqr, z_min, z_max, z_slope, z_iqr) of frame columns, by one pass over a clip's frames.

    Where all values are whole quarters (numbers of players, ball places), sums are whole numbers, and each of std, slope and the
    shapes is rounded once: a value on the tie of a later rounding, such as -65/32, comes out as that.
    """
    t, n = F.col("frame_id").cast("long"), F.count(F.lit(1))
    t1, t2 = F.try_sum(t), F.try_sum(F.try_multiply(t, t))
    times = F.try_subtract(F.try_multiply(n, t2), F.try_multiply(t1, t1)).cast("double")

    def one(name: str) -> Column:
        v = F.col(name).cast("double")
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
        unit = (v * _STEPS).try_cast("long")
        most = F.max(F.when(unit == v * _STEPS, F.abs(unit.cast("double"))).otherwise(_MOST))
        s1, s2, st = F.try_sum(unit), F.try_sum(F.try_multiply(unit, unit)), F.try_sum(F.try_multiply(t, unit))
        whole = most * n < _MOST
        root = F.when(whole, F.sqrt(F.try_subtract(F.try_multiply(n, s2), F.try_multiply(s1, s1)).cast("double")))  # n stds in quarters
        rise = F.when(whole & (times > 0), F.try_subtract(F.try_multiply(n, st), F.try_multiply(t1, s1)).cast("double"))
        plain = (_mean(v), F.coalesce(root / (_STEPS * n), F.stddev_pop(v)), F.min(v), F.max(v), F.coalesce(rise / (_STEPS * times), slope(v, t)), q[1] - q[0])
        mean, std, low, high, steep, iqr = plain
        away = lambda x: F.coalesce(F.try_divide(n * _STEPS * x - s1.cast("double"), root), (x - mean) / std)
        shapes = (away(low), away(high), F.coalesce(F.try_divide(n * rise, times * root), steep / std), F.coalesce(F.try_divide(n * _STEPS * iqr, root), iqr / std))
        flat = std < 1e-6
        return F.struct(F.lit(name).alias("channel"), *(x.alias(c) for c, x in zip(STATS, plain, strict=True)), *(F.when(flat, 0.0).otherwise(x).alias(f"z_{c}") for c, x in zip(SHAPES, shapes, strict=True)))

    return frames.groupBy(*keys).agg(F.array(*map(one, names)).alias("stats"))


def absolute_features(frames: DataFrame, names: Sequence[str] = MODEL_CHANNELS, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Six statistics of each channel over a clip, a row for each channel."""
    return _statistics(frames, names, keys).select(*keys, F.inline("stats")).select(*keys, "channel", *STATS)


def zscore(chan: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Adds z, the value's population z-score within its clip and channel; 0 without spread."""
    w = W.partitionBy(*keys, "channel")
    sd = F.stddev_pop("v").over(w)
    flat = (F.count("v").over(w) < 2) | (sd < 1e-6)
    return chan.withColumn("z", F.when(flat, 0.0).otherwise((F.col("v") - F.avg("v").over(w)) / sd))


def zscored_channels(frames: DataFrame, names: Sequence[str], keys: tuple[str, ...] = CLIP) -> DataFrame:
    """zscore() of channels(), from frame rows: means and spreads are taken over a clip's frames, before these become a row for each channel."""
    w = W.partitionBy(*keys)

    def one(name: str) -> Column:
        v = F.col(name).cast("double")
        sd = F.stddev_pop(v).over(w)
        z = F.when((F.count(v).over(w) < 2) | (sd < 1e-6), 0.0).otherwise((v - F.avg(v).over(w)) / sd)
        return F.struct(F.lit(name).alias("channel"), v.alias("v"), z.alias("z"))

    return frames.select(*keys, "frame_id", F.array(*map(one, names)).alias("cells")).select(*keys, "frame_id", F.inline("cells"))


def with_ratios(frames: DataFrame) -> DataFrame:
    """Adds the scale-free ratios to frame rows."""
    return frames.withColumns({n: ratio_clip(F.col(a), F.col(b)) for n, (a, b) in RATIOS.items()})


def invariant_features(frames: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """(keys, feature, value): statistics of ratios, and shape statistics of z-scored channels.

    A z-score is linear in its channel, so its statistics follow from the channel's own in one pass.
    """
    return feature_rows(frames, keys).where("mode = 'invariant'").drop("mode")


def feature_names(mode: str = "both") -> list[str]:
    """Names of a clip's features in their fixed order: 108 absolute ones, 132 invariant ones, or both in this order."""
    if mode not in MODES:
        raise ValueError(f"unknown feature mode {mode!r}: one of {', '.join(MODES)}")
    absolute = [f"{c}__{a}" for c in MODEL_CHANNELS for a in STATS]
    invariant = [f"{c}__{a}" for c in (*RATIOS, *DIMENSIONLESS) for a in STATS] + [f"{c}__z_{a}" for c in MODEL_CHANNELS for a in SHAPES]
    return {"absolute": absolute, "invariant": invariant, "both": absolute + invariant}[mode]


def feature_rows(frames: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """(keys, mode, feature, value) of the absolute and the invariant features, from frame_channels().

    Statistics of channels and ratios are taken in one pass; those of the channels serve the absolute features
    as well as the shapes and the channels without a scale.
    """
    own = _statistics(with_ratios(frames), (*MODEL_CHANNELS, *RATIOS), keys).select(*keys, F.inline("stats"))
    cell = lambda mode, name: F.struct(F.lit(mode).alias("mode"), F.concat(F.col("channel"), F.lit(f"__{name}")).alias("feature"), F.col(name).alias("value"))
    absolute, plain = (F.array(*(cell(mode, c) for c in STATS)) for mode in MODES[:2])
    shapes = F.array(*(cell("invariant", f"z_{c}") for c in SHAPES))
    cells = F.when(F.col("channel").isin(*RATIOS), plain).when(F.col("channel").isin(*DIMENSIONLESS), F.concat(absolute, plain, shapes)).otherwise(F.concat(absolute, shapes))
    return own.select(*keys, F.inline(cells))


def feature_vector(frames: DataFrame, mode: str = "both", keys: tuple[str, ...] = CLIP) -> DataFrame:
    """(keys, features): each clip's values in the order of feature_names(mode), null where a value is missing.

    Training and scoring both take their vectors from here, so their order can't differ.
    """
    kinds = [k for k in MODES[:2] if feature_names(mode) and mode in (k, "both")]
    names = [f"{kind}.{n}" for kind in kinds for n in feature_names(kind)]  # three channels have the same names in both kinds
    rows = feature_rows(frames, keys).where(F.col("mode").isin(*kinds))
    cells = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "mode", "feature"), "value"))).alias("all"))
    return cells.select(*keys, F.transform(F.array(*map(F.lit, names)), lambda n: F.element_at("all", n)).alias("features"))


def pad_windows(frames: DataFrame, size: int = WINDOW, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Each window with exactly ``size`` rows t = 0..size-1: cut, or padded with zero rows."""
    values = [c for c in frames.columns if c not in (*keys, "frame_id")]
    kept = F.struct("t", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in values))
    rows = frames.withColumn("t", F.col("frame_id") - F.min("frame_id").over(W.partitionBy(*keys)))
    clip = rows.groupBy(*keys).agg(F.collect_list(F.when(F.col("t") < size, kept)).alias("rows"))
    gaps = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), F.transform("rows", lambda q: q["t"].cast("long")))
    blank = F.transform(gaps, lambda t: F.struct(t.alias("t"), *(F.lit(0.0).alias(c) for c in values)))
    return clip.select(*keys, F.inline(F.concat("rows", blank)))
