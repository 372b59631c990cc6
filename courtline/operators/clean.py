"""Filters and projections over positions and detections.

positions: clip or match keys, frame_id, slot, x, y, ball_x, ball_y; missing is null once cleaned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import ENVELOPE_X, ENVELOPE_Y, NET_Y, STEP_CAP
from ..functions import geometry as G


def _pair(df: DataFrame, x: str, y: str, keep: Column) -> DataFrame:
    return df.withColumns({x: F.when(keep, F.col(x)), y: F.when(keep, F.col(y))})


def missing_normalise(df: DataFrame, pairs: tuple[tuple[str, str], ...] = (("x", "y"), ("ball_x", "ball_y"))) -> DataFrame:
    """(0, 0) and NaN become null, on both axes."""
    for x, y in pairs:
        df = _pair(df, x, y, ~((F.col(x) == 0) & (F.col(y) == 0)) & ~F.isnan(x) & ~F.isnan(y))
    return df


def envelope_filter(df: DataFrame, pairs: tuple[tuple[str, str], ...] = (("x", "y"), ("ball_x", "ball_y"))) -> DataFrame:
    """Positions outside the court's envelope become null, on both axes."""
    for x, y in pairs:
        df = _pair(df, x, y, F.col(x).between(*ENVELOPE_X) & F.col(y).between(*ENVELOPE_Y))
    return df


def clean_positions(df: DataFrame) -> DataFrame:
    return envelope_filter(missing_normalise(df))


def with_players(df: DataFrame, keys: tuple[str, ...] = ("match_id", "sequence", "frame_id")) -> DataFrame:
    """One row per frame: ball_x, ball_y and players (slot, x, y of those present, by slot)."""
    player = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("slot", "x", "y"))
    return df.groupBy(*keys).agg(F.max("ball_x").alias("ball_x"), F.max("ball_y").alias("ball_y"), F.array_sort(F.collect_list(player)).alias("players"))


def long_to_wide(df: DataFrame, keys: tuple[str, ...] = ("match_id", "frame_id")) -> DataFrame:
    """Slots as columns p1_x, p1_y .. p6_x, p6_y."""
    cells = [F.max(F.when(F.col("slot") == k, F.col(a))).alias(f"p{k}_{a}") for k in range(1, 7) for a in "xy"]
    return df.groupBy(*keys).agg(F.max("ball_x").alias("ball_x"), F.max("ball_y").alias("ball_y"), *cells)


def wide_to_long(df: DataFrame, keys: tuple[str, ...] = ("match_id", "frame_id")) -> DataFrame:
    """Columns p1_x .. p6_y as rows of slot, x, y; all six slots are kept."""
    slots = F.array(*(F.struct(F.lit(k).alias("slot"), F.col(f"p{k}_x").alias("x"), F.col(f"p{k}_y").alias("y")) for k in range(1, 7)))
    return df.select(*keys, "ball_x", "ball_y", F.inline(slots))


def register_explode_slots(spark: SparkSession, name: str = "explode_slots") -> None:
    """Registers a table function: (p1_x, p1_y, .. p6_x, p6_y) to rows slot, x, y, for LATERAL in SQL.

    A slot with a missing number comes out with nulls; all six slots come out always.
    """

    @F.udtf(returnType="slot int, x double, y double", useArrow=True)
    class ExplodeSlots:
        def eval(self, *cells: float | None):
            for k in range(0, len(cells), 2):
                x, y = cells[k], cells[k + 1]
                yield (k // 2 + 1, *((x, y) if x is not None and y is not None else (None, None)))

    spark.udtf.register(name, ExplodeSlots)


def team_side_filter(dets: DataFrame, y: Column, side: str = "bottom", margin: float = 0.0, most: int = 6) -> DataFrame:
    """Detections whose foot is on one side of the net; of more than ``most`` in a frame the deepest stay."""
    if side == "all":
        return dets
    depth = G.net_distance(y, side)
    first = W.partitionBy("video_id", "frame").orderBy(F.desc("depth"), "det_id")
    return dets.withColumn("depth", depth).where(F.col("depth") >= margin).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).drop("rank", "depth")


def best_ball(dets: DataFrame) -> DataFrame:
    """The ball detection with the highest confidence of each frame (least det_id on ties)."""
    best = F.max_by(F.struct("det_id", "x1", "y1", "x2", "y2", "conf"), F.struct("conf", -F.col("det_id")))
    return dets.where("kind = 'ball'").groupBy("video_id", "frame").agg(best.alias("b")).select("video_id", "frame", "b.*")


def ball_source_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ball of each frame from the first source, else from the second (video_id, frame, ball_cx, ball_cy)."""
    b = second.select("video_id", "frame", F.col("ball_cx").alias("other_x"), F.col("ball_cy").alias("other_y"))
    own = F.col("ball_cx").isNotNull()
    return first.join(b, ["video_id", "frame"], "full_outer").select("video_id", "frame", F.when(own, F.col("ball_cx")).otherwise(F.col("other_x")).alias("ball_cx"), F.when(own, F.col("ball_cy")).otherwise(F.col("other_y")).alias("ball_cy"), F.when(own, "first").otherwise("second").alias("source"))


def cap_steps(step: Column, cap: float = STEP_CAP) -> Column:
    """A displacement over the cap is a tracking error: null."""
    return F.when(step <= cap, step)


def stride_sample(df: DataFrame, n: int, frame: str = "frame_id") -> DataFrame:
    return df.where(F.col(frame) % n == 0)


def even_sample(df: DataFrame, n: int, keys: tuple[str, ...] = ("match_id",), frame: str = "frame_id") -> DataFrame:
    """n frames of each video, evenly spread from its first to its last one."""
    ends = df.groupBy(*keys).agg(F.min(frame).alias("low"), F.max(frame).alias("high"))
    index = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col("low") + i * (F.col("high") - F.col("low")) / max(1, n - 1)).cast("long"))
    return df.join(ends.select(*keys, F.explode(index).alias(frame)).distinct(), [*keys, frame], "left_semi")


def frame_time(frame: Column, fps: float) -> Column:
    return F.round(frame / fps, 3)


def eval_train_split(df: DataFrame, keys: tuple[str, ...], frame: str = "frame_id", train_last: int = 29, eval_last: int = 41) -> DataFrame:
    """Rows of the training frames (part 'train') and of the outcome frames ('eval'), of clips that have both."""
    part = F.when(F.col(frame).between(1, train_last), "train").when(F.col(frame).between(train_last + 1, eval_last), "eval")
    rows = df.withColumn("part", part).where("part is not null")
    both = rows.groupBy(*keys).agg(F.count_distinct("part").alias("n")).where("n = 2")
    return rows.join(both, list(keys), "left_semi")


def static_hotspot_filter(points: DataFrame, keys: tuple[str, ...], size: float = 30.0, least: int = 15, share: float = 0.15) -> DataFrame:
    """Without the points of bins that fired ``least`` times over ``share`` of the whole time span."""
    binned = points.withColumn("bx", F.floor(F.col("x") / size)).withColumn("by", F.floor(F.col("y") / size))
    span = points.groupBy(*keys).agg((F.max("t_s") - F.min("t_s")).alias("span"))
    bad = binned.groupBy(*keys, "bx", "by").agg(F.count("*").alias("n"), (F.max("t_s") - F.min("t_s")).alias("lasted"))
    bad = bad.join(span, list(keys)).where((F.col("n") >= least) & (F.col("lasted") >= share * F.col("span")))
    return binned.join(bad, [*keys, "bx", "by"], "left_anti").drop("bx", "by")


def clip_consistency(clips: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per clip 'sparse' (under three ball or player points), 'inconsistent' (ball and players on different sides of the net on average) or 'kept'."""
    agg = clips.groupBy(*keys).agg(F.sum("n_players").alias("n_player_points"), F.count("ball_y").alias("n_ball_points"), F.avg("ball_y").alias("ball_mean"), (F.sum("sum_y") / F.sum("n_players")).alias("player_mean"))
    sparse = (F.col("n_player_points") < 3) | (F.col("n_ball_points") < 3)
    return agg.withColumn("verdict", F.when(sparse, "sparse").when((F.col("ball_mean") - NET_Y) * (F.col("player_mean") - NET_Y) < 0, "inconsistent").otherwise("kept"))
