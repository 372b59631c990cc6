"""Teams by shirt colour: colour of each torso, clusters of a video's or clip's colours, team of each detection.

Pixels are a table of samples (keys of the box, px, py, h in 0..180, s and v in 0..255); nothing here
decodes pictures.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import NET_Y
from ..functions.geometry import geometric_team
from .identity import run_starts, whole_runs
from .stored import stored
from .teams import track_votes

#: The torso's share of a box, clusters, warm-up frames and samples, samples a clip needs.
TORSO = {"x": (0.25, 0.75), "y": (0.15, 0.50)}
CLUSTERS, WARMUP_FRAMES, WARMUP_SAMPLES, CLIP_SAMPLES = 4, 45, 60, 12
KEYS = ("video_id", "frame", "det_id")


def torso_colours(boxes: DataFrame, pixels: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds cx, cy, cv to boxes: median saturation along the median hue, and median value, of the torso's pixels.

    Boxes of at most a pixel's width or height, and those without pixels in the torso, have 0, 0, 0. Without a table of
    pixels each box holds its own, an array ``pixels`` of (px, py, h, s, v), which is left out of what comes back.
    """
    edge = lambda a, share: F.bround(F.col(f"{a}1") + share * (F.col(f"{a}2") - F.col(f"{a}1")), 0)
    wide = "x2 - x1 > 1 and y2 - y1 > 1"
    hue, sat = F.col("h") * (pi / 90), F.col("s") / 255
    colour = ((sat * F.cos(hue)).alias("cx"), (sat * F.sin(hue)).alias("cy"), (F.col("v") / 255).alias("cv"))
    if pixels is None:
        rows = boxes.withColumns({f"__{a}{k}": edge(a, TORSO[a][k]) for a in "xy" for k in (0, 1)})
        inside = lambda p: (p["px"] >= F.col("__x0")) & (p["px"] < F.col("__x1")) & (p["py"] >= F.col("__y0")) & (p["py"] < F.col("__y1"))
        rows = rows.withColumn("__in", F.when(F.expr(wide), F.filter("pixels", inside)))
        rows = rows.withColumns({c: F.array_sort(F.filter(F.col(f"__in.{c}"), F.isnotnull)) for c in "hsv"})
        middle = lambda c: (F.get(c, F.floor((F.size(c) - 1) / 2).cast("int")) + F.get(c, F.floor(F.size(c) / 2).cast("int"))) / 2
        rows = rows.withColumns({c: F.when(F.size(c) > 0, middle(c)) for c in "hsv"})
        return rows.select(*(c for c in boxes.columns if c != "pixels"), *colour).na.fill(0.0, ["cx", "cy", "cv"])
    torso = boxes.where(wide).select(*keys, *(edge(a, TORSO[a][k]).alias(f"__{a}{k}") for a in "xy" for k in (0, 1)))
    inside = pixels.join(torso, list(keys)).where("px >= __x0 and px < __x1 and py >= __y0 and py < __y1")
    middle = inside.groupBy(*keys).agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in "hsv"))
    return boxes.join(middle.select(*keys, *colour), list(keys), "left").na.fill(0.0, ["cx", "cy", "cv"])


def warmup_samples(colours: DataFrame, frames: int = WARMUP_FRAMES, samples: int = WARMUP_SAMPLES) -> DataFrame:
    """Colours up to the first frame of each video by which ``frames`` frames and ``samples`` feet on the court were seen.

    A video that ends before has no warm-up and no rows. Frames without detections are not known here.
    """
    per = colours.groupBy("video_id", "frame").agg(F.count("y").alias("n"))
    w = W.partitionBy("video_id").orderBy("frame")
    seen = per.select("video_id", "frame", F.row_number().over(w).alias("k"), F.sum("n").over(w).alias("total"))
    end = seen.where((F.col("k") >= frames) & (F.col("total") >= samples)).groupBy("video_id").agg(F.min("frame").alias("fit_frame"))
    return colours.join(F.broadcast(end), "video_id").where("frame <= fit_frame and y is not null")  # a row a video


def cluster(x: np.ndarray, k: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds from the first point and then always the farthest one: (centres, labels), the same for the same rows."""
    picked = [0]
    for _ in range(min(k, len(x)) - 1):
        d2 = ((x[:, None] - x[picked]) ** 2).sum(-1).min(1)
        if not d2.max() > 0:
            break
        picked.append(int(d2.argmax()))
    centres, labels = x[picked].copy(), np.full(len(x), -1)
    for _ in range(rounds):
        now = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
        if (now == labels).all():
            break
        labels = now
        for j in np.unique(labels):
            centres[j] = x[labels == j].mean(0)
    return centres, labels


def clusters_of(group: np.ndarray, x: np.ndarray, k: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """``cluster`` of many groups at once: centres (groups, k, columns), infinite where a group has fewer, and labels.

    group: each row's, ascending from 0 without gaps. Sums run in the order of rows, so each group's result is that of ``cluster``.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n, place = len(starts), np.arange(len(x))
    centres = np.full((n, k, x.shape[1]), np.inf)
    centres[:, 0] = x[starts]
    least, growing = ((x - centres[group, 0]) ** 2).sum(-1), np.ones(n, bool)
    for j in range(1, k):
        far = np.maximum.reduceat(least, starts)
        growing &= far > 0  # not so for NaN either
        first = np.minimum.reduceat(np.where(least == far[group], place, len(x)), starts)
        centres[growing, j] = x[first[growing]]
        least = np.where(growing[group], np.minimum(least, ((x - centres[group, j]) ** 2).sum(-1)), least)
    labels, rows = np.full(len(x), -1), place
    for _ in range(rounds):
        own = group[rows]
        now = ((x[rows, None] - centres[own]) ** 2).sum(-1).argmin(1)
        moving = np.bincount(own, now != labels[rows], n) > 0
        if not moving.any():
            break
        labels[rows] = now
        rows, now = rows[moving[own]], now[moving[own]]
        at = group[rows] * k + now
        size = np.bincount(at, minlength=n * k)
        used = np.flatnonzero(size)
        for a in range(x.shape[1]):
            centres.reshape(n * k, -1)[used, a] = np.bincount(at, x[rows, a], n * k)[used] / size[used]
    return centres, labels


def _medians(group: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Median of each group's values; NaN with a NaN and without rows."""
    v = v[np.lexsort((v, group))]
    size = np.bincount(group, minlength=n)
    start = np.cumsum(size) - size
    low, high = (np.minimum(start + np.maximum(size - 1, 0) // 2, len(v) - 1), np.minimum(start + size // 2, len(v) - 1))
    bad = (size == 0) | np.isnan(v[np.clip(start + size - 1, 0, len(v) - 1)])
    return np.where(bad, np.nan, (v[low] + v[high]) / 2)


def _fitted(table: pa.Table, n_keys: int, least: int, clusters: int) -> pa.Table:
    """Whole groups, sorted by keys, frame and detection, to their clusters."""
    table = table.filter(table.column("y").is_valid()).combine_chunks()
    keys = [table.column(c).combine_chunks() for c in range(n_keys)]
    starts = run_starts(table, n_keys)
    group, at = np.cumsum(starts) - 1, np.flatnonzero(starts)
    keep = np.bincount(group)[group] >= least
    names = [*table.column_names[:n_keys], "cluster", "cx", "cy", "cv", "n", "median_y"]
    if not keep.any():
        return pa.table([*(c.slice(0, 0) for c in keys), pa.array([], pa.int32()), *([pa.array([], pa.float64())] * 3), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    known, group = np.unique(group[keep], return_inverse=True)
    y, *colour = (table.column(c).to_numpy(zero_copy_only=False).astype(float)[keep] for c in ("y", "cx", "cy", "cv"))
    centres, labels = clusters_of(group, np.stack(colour, axis=1), clusters)
    cell, n = group * clusters + labels, len(known) * clusters
    size = np.bincount(cell, minlength=n)
    used = np.flatnonzero(size)
    of, flat = pa.array(at[known][used // clusters]), centres.reshape(n, -1)[used]
    return pa.table([*(c.take(of) for c in keys), pa.array((used % clusters).astype(np.int32)), *(pa.array(flat[:, a]) for a in range(3)), pa.array(size[used].astype(np.int64)), pa.array(_medians(cell, y, n)[used])], names=names)


def fit_teams(samples: DataFrame, keys: Sequence[str] = ("video_id",), least: int = 1, clusters: int = CLUSTERS, net_y: float = NET_Y, dealt: bool = False) -> DataFrame:
    """Clusters of each key's colours: keys, cluster, cx, cy, cv, n, median_y, team, degenerate.

    A cluster is NEAR if its median foot is at the net or before it, else FAR; a fit with one team only is
    degenerate. samples: a warm-up or a clip, so a group is a few hundred rows; keys with fewer than
    ``least`` have no clusters. Groups are sorted inside their partitions and fitted many at once, batch by batch.
    dealt: samples begin with keys and are dealt by them; they are read with all their columns, so that others can share the exchange.
    """
    kinds = dict(samples.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "cluster int, cx double, cy double, cv double, n long, median_y double"])
    own = [*keys, *(c for c in ("frame", "det_id", "y", "cx", "cy", "cv") if c not in keys)]
    rows = (samples if dealt else samples.where("y is not null").select(*own).repartition(*keys)).sortWithinPartitions(*keys, "frame", "det_id")
    out = rows.mapInArrow(whole_runs(len(keys), lambda table: _fitted(table, len(keys), least, clusters)), schema)
    out = out.withColumn("team", F.when(F.col("median_y") >= net_y, "NEAR").otherwise("FAR"))
    return out.withColumn("degenerate", F.min("team").over(W.partitionBy(*keys)) == F.max("team").over(W.partitionBy(*keys)))


def _half(net_y: float) -> Column:
    return geometric_team(F.col("y") - net_y + NET_Y)


def colour_teams(colours: DataFrame, fitted: DataFrame, keys: Sequence[str] = ("video_id",), net_y: float = NET_Y, few: bool = False) -> DataFrame:
    """Adds team and by_colour: the team of the nearest centre, or the half of the court where there is no fit, or a degenerate one.

    few: fits are broadcast.
    """
    sets = fitted.where("not degenerate").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "cx", "cy", "cv", "team"))).alias("__all"))
    square = lambda a, b: (a - b) * (a - b)
    away = F.transform("__all", lambda c: F.struct(sum(square(F.col(a), c[a]) for a in ("cx", "cy", "cv")).alias("d2"), c["cluster"].alias("cluster"), c["team"].alias("team")))
    both = colours.join(F.broadcast(sets) if few else sets, list(keys), "left")
    return both.withColumn("by_colour", F.col("__all").isNotNull()).withColumn("team", F.coalesce(F.array_min(away)["team"], _half(net_y))).drop("__all")


def video_teams(colours: DataFrame, net_y: float = NET_Y) -> DataFrame:
    """``colour_teams`` by one fit on each video's warm-up; up to its last frame the half of the court decides."""
    colours = stored(colours, "colours")  # medians of pixels are taken once
    warm = stored(warmup_samples(colours), "warmup")
    ends = F.broadcast(warm.groupBy("video_id").agg(F.max("fit_frame").alias("fit_frame")))  # a row a video, as the fits are
    named = colour_teams(colours, fit_teams(warm, net_y=net_y), net_y=net_y, few=True).join(ends, "video_id", "left")
    late = F.col("by_colour") & (F.col("frame") > F.col("fit_frame"))
    return named.withColumn("team", F.when(late, F.col("team")).otherwise(_half(net_y))).withColumn("by_colour", late)


def clip_team_select(colours: DataFrame, want: str = "NEAR", net_y: float = NET_Y) -> DataFrame:
    """Detections of the wanted team: one fit for each clip with enough samples, then votes over each track.

    colours: video_id, clip, frame, det_id, track_id, y, cx, cy, cv. Votes begin anew with each clip. Rows are dealt by clip once;
    fit, teams and votes are taken there.
    """
    clip = ("video_id", "clip")
    rows = colours.select(*clip, *(c for c in colours.columns if c not in clip)).repartition(*clip)
    named = colour_teams(rows, fit_teams(rows, clip, CLIP_SAMPLES, net_y=net_y, dealt=True), clip, net_y)
    return track_votes(named, clip).where(F.col("voted") == want)
