"""The four tactical rules over outcome windows, and the label they give.

The rules read raw positions, where (0, 0) stands for missing. With ``parity`` the rules on
speed and reaction take such places as they are, as the reference data was labelled; without
it they are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FPS, LABELS
from ..functions import geometry as G

CLIP = ("match_id", "sequence")


def _seen(x: str = "x", y: str = "y") -> Column:
    return ~((F.col(x) == 0) & (F.col(y) == 0))


def _indexed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds i, the frame's place in its clip from 0, the same for all slots."""
    return rows.withColumn("i", F.dense_rank().over(W.partitionBy(*keys).orderBy("frame_id")) - 1)


def spacing_rule(rows: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """spacing: in some frame a nearest neighbour is over 600 cm away, or one is under 50 cm."""
    player = F.when(_seen(), F.struct("slot", "x", "y"))
    frames = rows.groupBy(*keys, "frame_id").agg(F.collect_list(player).alias("p"))
    near = F.when(F.size("p") >= 2, G.nearest_distances(F.col("p")))
    return frames.groupBy(*keys).agg(F.coalesce(F.max((F.array_max(near) > 600) | (F.array_min(near) < 50)), F.lit(False)).alias("spacing"))


def ball_frames(rows: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """One row per frame with its index i, the ball, and the ball's steps from the frame before."""
    ball = rows.groupBy(*keys, "frame_id").agg(F.max("ball_x").alias("ball_x"), F.max("ball_y").alias("ball_y"))
    w = W.partitionBy(*keys).orderBy("frame_id")
    return ball.withColumn("i", F.row_number().over(w) - 1).withColumn("dx", F.col("ball_x") - F.lag("ball_x").over(w)).withColumn("dy", F.col("ball_y") - F.lag("ball_y").over(w))


def impact_frames(ball: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """impact: index of the first step at which the ball's y-velocity changes sign or is zero, else of its first sudden stop; null without either or without a ball."""
    w = W.partitionBy(*keys).orderBy("i")
    step = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    rows = ball.withColumn("step", step).withColumn("before", F.lag("dy").over(w)).withColumn("step_before", F.lag("step").over(w))
    turn = F.min(F.when(F.col("before") * F.col("dy") <= 0, F.col("i") - 1))
    stop = F.min(F.when((F.col("step_before") > 5) & (F.col("step") < F.col("step_before") * 0.4), F.col("i") - 1))
    return rows.groupBy(*keys).agg(F.when(F.max(_seen("ball_x", "ball_y")), F.coalesce(turn, stop)).alias("impact"))


def nearest_at_impact(rows: DataFrame, keys: tuple[str, ...] = CLIP, parity: bool = True) -> DataFrame:
    """closest: the slot nearest to the ball at the impact frame (the lowest on ties)."""
    at = _indexed(rows, keys).join(impact_frames(ball_frames(rows, keys), keys), list(keys)).where("i = impact")
    d = G.distance(F.col("x"), F.col("y"), F.col("ball_x"), F.col("ball_y"))
    d = d if parity else F.when(_seen(), d)
    return at.withColumn("d", d).where("d is not null").groupBy(*keys, "impact").agg(F.min_by("slot", F.struct("d", "slot")).alias("closest"))


def peak_frames(rows: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """peak: index of each slot's first largest step."""
    w = W.partitionBy(*keys, "slot").orderBy("frame_id")
    step = G.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    rows = rows.withColumn("i", F.row_number().over(w) - 2).withColumn("step", step)
    return rows.where("step is not null").groupBy(*keys, "slot").agg(F.min_by("i", F.struct(-F.col("step"), "i")).alias("peak"))


def delayed_rule(rows: DataFrame, keys: tuple[str, ...] = CLIP, parity: bool = True) -> DataFrame:
    """delayed: the player nearest at impact reaches its highest speed more than five frames later."""
    source = rows if parity else rows.withColumns({a: F.when(_seen(), F.col(a)) for a in "xy"})
    near = nearest_at_impact(rows, keys, parity).withColumnRenamed("closest", "slot").join(peak_frames(source, keys), [*keys, "slot"])
    hit = near.select(*keys, (F.col("peak") - F.col("impact") > 5).alias("delayed"))
    return rows.select(*keys).distinct().join(hit, list(keys), "left").select(*keys, F.coalesce("delayed", F.lit(False)).alias("delayed"))


def attack_rule(rows: DataFrame, keys: tuple[str, ...] = CLIP, parity: bool = True) -> DataFrame:
    """attack: the ball is seen and once below 500 cm, the two fastest players average over 300 cm/s and the rest under 150."""
    source = rows if parity else rows.withColumns({a: F.when(_seen(), F.col(a)) for a in "xy"})
    w = W.partitionBy(*keys, "slot").orderBy("frame_id")
    step = G.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    speeds = source.withColumn("step", step).groupBy(*keys, "slot").agg((F.avg("step") * FPS).alias("v"))
    ranked = F.reverse(F.array_sort(F.collect_list("v")))
    teams = speeds.groupBy(*keys).agg(ranked.alias("v")).select(*keys, G.mean_of(F.slice("v", 1, 2)).alias("top2"), G.mean_of(F.slice("v", 3, 4)).alias("rest"))
    ball = rows.groupBy(*keys).agg((F.max(_seen("ball_x", "ball_y")) & F.max(F.col("ball_y") < 500)).alias("near_net"))
    return teams.join(ball, list(keys)).select(*keys, F.coalesce(F.col("near_net") & (F.col("top2") > 300) & (F.col("rest") < 150), F.lit(False)).alias("attack"))


def defense_rule(rows: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """defense: the centroid moves over 3 cm a frame while the spatial variance stays within 30 percent."""
    own = lambda c: F.coalesce(F.avg(F.when(_seen(), F.col(c))), F.avg(c))
    frames = rows.groupBy(*keys, "frame_id").agg(own("x").alias("cx"), own("y").alias("cy"), F.var_pop(F.when(_seen(), F.col("x"))).alias("vx"), F.var_pop(F.when(_seen(), F.col("y"))).alias("vy"))
    w = W.partitionBy(*keys).orderBy("frame_id")
    step = G.distance(F.col("cx"), F.col("cy"), F.lag("cx").over(w), F.lag("cy").over(w))
    frames = frames.withColumn("step", step).withColumn("sv", F.coalesce(F.col("vx") + F.col("vy"), F.lit(0.0)))
    out = frames.groupBy(*keys).agg(F.avg("step").alias("move"), F.avg("sv").alias("mean_sv"), F.stddev_pop("sv").alias("std_sv"))
    return out.select(*keys, F.coalesce((F.col("move") > 3) & (F.col("mean_sv") != 0) & (F.col("std_sv") < 0.3 * F.col("mean_sv")), F.lit(False)).alias("defense"))


def _all_rules(rows: DataFrame, keys: tuple[str, ...], parity: bool) -> DataFrame:
    """keys, attack, defense, delayed and spacing, as the four rules give them, in one pass: rows are dealt by clip once."""
    k = W.partitionBy(*keys)
    rows = rows.withColumn("i", F.dense_rank().over(k.orderBy("frame_id")) - 1)
    # rows: each slot's steps, its mean speed (told once) and its peak
    w, slot = W.partitionBy(*keys, "slot").orderBy("frame_id"), W.partitionBy(*keys, "slot")
    own = {a: F.col(a) if parity else F.when(_seen(), F.col(a)) for a in "xy"}
    rows = rows.withColumns({f"__{a}": v for a, v in own.items()})
    step = G.distance(F.col("__x"), F.col("__y"), F.lag("__x").over(w), F.lag("__y").over(w))
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("step", step)
    rows = rows.withColumn("v", F.avg("step").over(slot) * FPS).withColumn("peak", F.min_by(F.col("k") - 2, F.when(F.col("step").isNotNull(), F.struct(-F.col("step"), "k"))).over(slot))
    away = G.distance(F.col("x"), F.col("y"), F.col("ball_x"), F.col("ball_y"))
    away = away if parity else F.when(_seen(), away)
    centre = lambda c: F.coalesce(F.avg(F.when(_seen(), F.col(c))), F.avg(c))
    frames = rows.groupBy(*keys, "frame_id", "i").agg(
        F.max("ball_x").alias("ball_x"),
        F.max("ball_y").alias("ball_y"),
        F.max(_seen("ball_x", "ball_y")).alias("seen"),
        F.max(F.col("ball_y") < 500).alias("low"),
        F.collect_list(F.when(_seen(), F.struct("slot", "x", "y"))).alias("p"),
        F.collect_list(F.when(F.col("k") == 1, F.col("v"))).alias("v"),
        F.array_min(F.collect_list(F.when(away.isNotNull(), F.struct(away.alias("d"), "slot", "peak")))).alias("closest"),
        centre("x").alias("cx"),
        centre("y").alias("cy"),
        F.coalesce(F.var_pop(F.when(_seen(), F.col("x"))) + F.var_pop(F.when(_seen(), F.col("y"))), F.lit(0.0)).alias("sv"),
    )
    # frames: the ball's turn or stop, the centroid's steps, neighbours
    t = k.orderBy("i")
    frames = frames.withColumns({"dx": F.col("ball_x") - F.lag("ball_x").over(t), "dy": F.col("ball_y") - F.lag("ball_y").over(t), "move": G.distance(F.col("cx"), F.col("cy"), F.lag("cx").over(t), F.lag("cy").over(t))})
    frames = frames.withColumn("step", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    frames = frames.withColumns({"before": F.lag("dy").over(t), "step_before": F.lag("step").over(t)})
    turn = F.min(F.when(F.col("before") * F.col("dy") <= 0, F.col("i") - 1)).over(k)
    stop = F.min(F.when((F.col("step_before") > 5) & (F.col("step") < F.col("step_before") * 0.4), F.col("i") - 1)).over(k)
    ball = F.max(_seen("ball_x", "ball_y")).over(k)
    frames = frames.withColumn("impact", F.when(ball, F.coalesce(turn, stop))).withColumn("near", F.when(F.size("p") >= 2, G.nearest_distances(F.col("p"))))
    out = frames.groupBy(*keys).agg(
        F.max("seen").alias("seen"),
        F.max("low").alias("low"),
        F.reverse(F.array_sort(F.flatten(F.collect_list("v")))).alias("v"),
        F.max(F.when(F.col("i") == F.col("impact"), F.col("closest.peak") - F.col("impact") > 5)).alias("delayed"),
        F.max((F.array_max("near") > 600) | (F.array_min("near") < 50)).alias("spacing"),
        F.avg("move").alias("move"),
        F.avg("sv").alias("mean_sv"),
        F.stddev_pop("sv").alias("std_sv"),
    )
    attack = F.col("seen") & F.col("low") & (G.mean_of(F.slice("v", 1, 2)) > 300) & (G.mean_of(F.slice("v", 3, 4)) < 150)
    defense = (F.col("move") > 3) & (F.col("mean_sv") != 0) & (F.col("std_sv") < 0.3 * F.col("mean_sv"))
    no = F.lit(False)
    return out.select(*keys, *(F.coalesce(c, no).alias(name) for name, c in (("attack", attack), ("defense", defense), ("delayed", F.col("delayed")), ("spacing", F.col("spacing")))))


def label_clips(rows: DataFrame, keys: tuple[str, ...] = CLIP, parity: bool = True) -> DataFrame:
    """All four rules and the label: attack, defence, delayed support, spacing breakdown, else unclassified."""
    out = _all_rules(rows, keys, parity)
    label = F.when(F.col("attack"), "Coordinated Attack").when(F.col("defense"), "Coordinated Defense").when(F.col("delayed"), "Delayed Support").when(F.col("spacing"), "Spacing Breakdown").otherwise("Unclassified")
    return out.withColumn("label", label)


def label_report(labels: DataFrame) -> DataFrame:
    """Count and share of each label (those that don't occur, too) with the totals, efficiency and quality band."""
    every = labels.sparkSession.createDataFrame([(v, k) for k, v in LABELS.items()], "label_index int, label string")
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    rows = every.join(F.broadcast(counts), "label", "left").select("label_index", "label", F.coalesce("n", F.lit(0)).alias("n"))
    part = lambda names: F.sum(F.when(F.col("label").isin(*names), F.col("n")).otherwise(0))
    total = rows.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label_index") > 0, F.col("n")).otherwise(0)).alias("tactical"), part(("Coordinated Attack", "Coordinated Defense")).alias("good"), F.max_by("label", F.struct("n", -F.col("label_index"))).alias("dominant"))
    share = F.when(F.col("total") > 0, F.bround(F.col("n") / F.col("total") * 100, 1)).otherwise(0.0)
    efficiency = F.when(F.col("tactical") > 0, F.bround(F.col("good") / F.col("tactical") * 100, 1)).otherwise(0.0)
    out = rows.join(F.broadcast(total)).withColumn("percent", share).withColumn("efficiency", efficiency)
    band = F.when(F.col("efficiency") >= 60, "strong").when(F.col("efficiency") >= 40, "moderate").otherwise("weak")
    return out.select("label_index", "label", "n", "percent", "total", "tactical", "efficiency", "dominant", band.alias("band"), F.concat(F.repeat(F.lit("█"), F.floor(F.col("percent") / 5).cast("int")), F.repeat(F.lit("░"), 20 - F.floor(F.col("percent") / 5).cast("int"))).alias("bar"))
