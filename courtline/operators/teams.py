"""Team of each track from votes over time, checks before a job, and novelty of clips."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import NET_Y, TACTICS
from .stored import stored


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equal keys; null is equal to null."""
    return reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)))


def _with_runs(rows: DataFrame, forget: bool, chunk: int) -> DataFrame:
    """Adds __start, the first frame of the track's run. A track is cut into chunks of frames; a row for each chunk tells the next ones how it ended."""
    keys = ["video_id", "track_id", "__chunk"]
    rows = rows.withColumn("__chunk", F.floor(F.col("frame") / chunk).cast("long"))
    inside = W.partitionBy(*keys).orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(inside)
    rows = rows.withColumn("__begun", F.when(F.lit(forget) & (gap > 1), F.col("frame")))
    ends = rows.groupBy(*keys).agg(F.min("frame").alias("__first"), F.max("frame").alias("__last"), F.max("__begun").alias("__own"))
    order = W.partitionBy("video_id", "track_id").orderBy("__chunk")
    away = F.col("__first") - F.lag("__last").over(order)
    ends = ends.withColumn("__anew", F.when(away.isNull() | (F.lit(forget) & (away > 1)), F.col("__first")))
    carried = F.coalesce("__anew", F.last(F.coalesce("__own", "__anew"), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    ends = ends.select(*(F.col(k).alias(f"{k}_of") for k in keys), carried.alias("__carried"))
    start = F.coalesce(F.last("__begun", ignorenulls=True).over(inside), F.col("__carried"))
    return rows.join(ends, _same(keys, [f"{k}_of" for k in keys]), "left").withColumn("__start", start).drop("__chunk", "__begun", "__carried", *(f"{k}_of" for k in keys))


def team_votes(rows: DataFrame, decay: float = 0.98, least: float = 0.0, ratio: float = 1.0, forget: bool = True, chunk: int = 4096) -> DataFrame:
    """Adds near, far (decayed votes) and voted to rows (video_id, frame, track_id, team NEAR, FAR or UNKNOWN).

    A track that misses a frame begins anew unless ``forget`` is off; votes fade by ``decay`` a
    frame. Sums are taken relative to blocks of frames in which votes fade to a billionth, and of
    the blocks before two are added (older votes are below a double's precision). No window holds
    more of a track than ``chunk`` frames or a block.
    """
    rows, block, size = _sums_of_blocks(_with_runs(stored(rows, "votes"), forget, chunk), decay)
    totals = rows.groupBy(*block).agg(*(F.max(c).alias(c) for c in ("near", "far")))  # sums of what isn't negative end at their largest
    run = W.partitionBy(*block[:-1]).orderBy("__block")
    before = lambda c: sum(F.coalesce(F.max(c).over(run.rangeBetween(-i, -i)), F.lit(0.0)) * decay ** (i * size) for i in (1, 2))
    totals = totals.select(*(F.col(c).alias(f"{c}_of") for c in block), *(before(c).alias(f"__{c}") for c in ("near", "far"))).where("__near > 0 or __far > 0")
    rows = rows.join(totals, _same(block, [f"{c}_of" for c in block]), "left")
    return _voted(rows, decay, least, ratio).drop(*(f"{c}_of" for c in block))


def track_votes(rows: DataFrame, keys: Sequence[str] = ("video_id",), decay: float = 0.98, least: float = 0.0, ratio: float = 1.0, forget: bool = True) -> DataFrame:
    """``team_votes`` of keys that a task can hold (clips): windows over tracks alone, so rows dealt by ``keys`` need no exchange."""
    track = W.partitionBy(*keys, "track_id").orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(track)
    start = F.last(F.when(gap.isNull() | (F.lit(forget) & (gap > 1)), F.col("frame")), ignorenulls=True).over(track)
    rows, block, size = _sums_of_blocks(rows.withColumn("__start", start), decay, keys)
    run = W.partitionBy(*block[:-1]).orderBy("__block")
    before = lambda c: sum(F.coalesce(F.max(c).over(run.rangeBetween(-i, -i)), F.lit(0.0)) * decay ** (i * size) for i in (1, 2))
    return _voted(rows.withColumns({f"__{c}": before(c) for c in ("near", "far")}), decay, least, ratio)


def _sums_of_blocks(rows: DataFrame, decay: float, keys: Sequence[str] = ("video_id",)) -> tuple[DataFrame, list[str], int]:
    """Adds __k, __block and the sums near and far of a block so far to rows with __start; the keys of a block; its frames."""
    size = int(log(1e9) / -log(decay)) if decay < 1 else 1 << 40
    k = F.col("frame") - F.col("__start")
    rows = rows.withColumn("__k", F.pmod(k, F.lit(size))).withColumn("__block", F.floor(k / size).cast("long"))
    block = [*keys, "track_id", "__start", "__block"]
    own = W.partitionBy(*block).orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    for team in ("NEAR", "FAR"):
        rows = rows.withColumn(team.lower(), F.sum(F.when(F.col("team") == team, F.pow(F.lit(decay), -F.col("__k"))).otherwise(0.0)).over(own))
    return rows, block, size


def _voted(rows: DataFrame, decay: float, least: float, ratio: float) -> DataFrame:
    """near, far and voted from the sums of a block and of those before it."""
    rows = rows.withColumns({c: (F.coalesce(f"__{c}", F.lit(0.0)) + F.col(c)) * F.pow(F.lit(decay), F.col("__k")) for c in ("near", "far")})
    voted = F.when(F.greatest("near", "far") < least, "UNKNOWN").when(F.col("near") > F.col("far") * ratio, "NEAR").when(F.col("far") > F.col("near") * ratio, "FAR").otherwise("UNKNOWN")
    return rows.withColumn("voted", voted).drop("__start", "__k", "__near", "__far", "__block")


def team_vote_filter(voted: DataFrame, want: str = "NEAR", margin: float = 0.0, most: int = 6) -> DataFrame:
    """Rows (with foot y) whose voted team and own side are the wanted ones; the deepest ``most`` of a frame."""
    depth = F.col("y") - NET_Y if want == "NEAR" else NET_Y - F.col("y")
    first = W.partitionBy("video_id", "frame").orderBy(F.desc("depth"), "det_id")
    return voted.withColumn("depth", depth).where((F.col("voted") == want) & (F.col("depth") >= margin)).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).drop("rank", "depth")


def preflight_verdict(stats: DataFrame) -> DataFrame:
    """Findings (level, stage, message) for rows of raw_person_median, masked_person_median, team_person_median and ball_recall; a fatal early stage hides the later ones."""
    raw, masked, team, ball = (F.col(c) for c in ("raw_person_median", "masked_person_median", "team_person_median", "ball_recall"))
    find = lambda level, stage, text, *args: F.struct(F.lit(level).alias("level"), F.lit(stage).alias("stage"), F.format_string(text, *args).alias("message"))
    blind, hidden = raw < 4, masked <= 0
    first = F.when(blind, find("FATAL", "detection", "median %.1f people a frame: too few for a rally", raw)).when(hidden, find("FATAL", "court mask", "the court mask kept none of %.1f people a frame", raw))
    split = F.when(~blind & ~hidden, F.when(team <= 0, find("FATAL", "team split", "none of %.1f people a frame is left", masked)).when(team < 3, find("FATAL", "team split", "median %.1f players a frame: too few for a formation", team)).when(team > 9, find("WARN", "team split", "median %.1f players a frame: opponents are among them", team)).when(F.abs(team - 6) > 2, find("WARN", "team split", "median %.1f players a frame instead of 6", team)))
    lost = F.when(~blind & ~hidden & (ball < 0.2), find("WARN", "ball", "ball found in %.0f%% of frames", ball * 100))
    keys = [c for c in stats.columns if c not in ("raw_person_median", "masked_person_median", "team_person_median", "ball_recall")]
    return stats.select(*keys, F.inline(F.filter(F.array(first, split, lost), lambda x: x.isNotNull())))


def require(findings: DataFrame) -> None:
    """Stop a job before it starts if any finding is fatal."""
    bad = findings.where("level = 'FATAL'").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['stage']}: {r['message']}" for r in bad))


def reference_table(metrics: DataFrame, ranges: Sequence[tuple[str, float, float, str]]) -> DataFrame:
    """Median of each metric against a published range: below, within or above."""
    dim = metrics.sparkSession.createDataFrame(list(ranges), "metric string, low double, high double, unit string")
    names = [r[0] for r in ranges]
    long = metrics.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names))))
    own = long.groupBy("metric").agg(F.percentile("v", F.lit(0.5)).alias("median"), F.count("v").alias("n"))
    place = F.when(F.col("median") < F.col("low"), "below").when(F.col("median") > F.col("high"), "above").otherwise("within")
    return own.join(F.broadcast(dim), "metric", "left").select("metric", "median", "n", F.format_string("%.1f %s (%.0f-%.0f)", "median", "unit", "low", "high").alias("text"), F.when(F.col("median").isNotNull(), place).alias("place"))


def tactical_deviation(metrics: DataFrame, columns: Sequence[str], label: str = "label", least: int = 8) -> DataFrame:
    """Adds deviation: Mahalanobis distance of each clip from the clips labelled attack or defence.

    Missing values are the median; columns are standardised over all clips. Only sums over clips
    (one row of means and covariances of len(columns) columns) reach the driver. With fewer than
    ``least`` reference clips the deviation is null.
    """
    metrics = stored(metrics, "metrics")  # read for medians, scales, covariances and the result
    ref = F.col(label).isin(*TACTICS[:2])
    medians = metrics.agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in columns)).first()
    filled = metrics.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]) if medians[c] is not None else 0.0)) for c in columns})
    scale = filled.agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
    z = {f"__{c}": (F.col(c) - float(scale[f"m_{c}"] or 0)) / (float(scale[f"s_{c}"] or 0) + 1e-9) for c in columns}
    rows = filled.withColumns(z)
    names = list(z)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = rows.where(ref).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in names), *(F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs)).first()
    if got["n"] < least:
        return metrics.withColumn("deviation", F.lit(None).cast("double"))
    cov = np.zeros((len(names), len(names)))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        cov[i, j] = cov[j, i] = got[f"{a}|{b}"] or 0.0
    inverse = np.linalg.pinv(cov + 0.01 * np.eye(len(names)))
    d = [F.col(n) - float(got[f"m{n}"]) for n in names]
    square = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    values = rows.withColumn("deviation", F.sqrt(F.greatest(square, F.lit(0.0))))
    return values.drop(*names)
