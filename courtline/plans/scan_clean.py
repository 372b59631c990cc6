"""Queries of filters and projections over positions and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import clean
from .base import CLIP_FRAME, POS, RAW, Query, R, positions, r, rounded
from .geometry import DET

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_K = ("match_id", "frame_id", "slot")
_sel = lambda df: rounded(df.select(*_K, "x", "y", "ball_x", "ball_y"))
_xy = lambda ok, a, b: ", ".join(f"{R(f'CASE WHEN {ok} THEN {c} END')} AS {c}" for c in (a, b))
_miss = lambda a, b: f"NOT ({a} = 0 AND {b} = 0)"
_env = lambda a, b: f"{a} BETWEEN -900 AND 2700 AND {b} BETWEEN -1800 AND 1800"
_add("flt1_missing_normalise", lambda s, d: _sel(clean.missing_normalise(X.raw_positions(s, d))), f"WITH {RAW} SELECT match_id, frame_id, slot, {_xy(_miss('x', 'y'), 'x', 'y')}, {_xy(_miss('ball_x', 'ball_y'), 'ball_x', 'ball_y')} FROM raw")
_add("flt2_envelope_filter", lambda s, d: _sel(clean.envelope_filter(X.raw_positions(s, d).withColumn("x", F.col("x") * 3))), f"WITH {RAW}, w AS (SELECT match_id, frame_id, slot, x * 3 AS x, y, ball_x, ball_y FROM raw) SELECT match_id, frame_id, slot, {_xy(_env('x', 'y'), 'x', 'y')}, {_xy(_env('ball_x', 'ball_y'), 'ball_x', 'ball_y')} FROM w")
_cells = ", ".join(f"{R(f'max(CASE WHEN slot = {k} THEN {a} END)')} AS p{k}_{a}" for k in range(1, 7) for a in "xy")
_add("prj1_long_to_wide", lambda s, d: rounded(clean.long_to_wide(positions(s, d))), f"WITH {POS} SELECT match_id, frame_id, {R('max(ball_x)')} AS ball_x, {R('max(ball_y)')} AS ball_y, {_cells} FROM pos GROUP BY 1, 2")
_add("prj1_wide_to_long", lambda s, d: _sel(clean.wide_to_long(clean.long_to_wide(positions(s, d)))), f"WITH {POS} SELECT match_id, frame_id, slot, {R('x')} AS x, {R('y')} AS y, {R('ball_x')} AS ball_x, {R('ball_y')} AS ball_y FROM pos")
_add("prj2_frame_time", lambda s, d: X.detections(s, d).select("video_id", "frame", "det_id", clean.frame_time(F.col("frame"), 30.0).alias("time_s")), f"WITH {DET} SELECT video_id, frame, det_id, round(frame / CAST(30 AS DOUBLE), 3) AS time_s FROM det")
_add("src2_detections_scan", lambda s, d: X.detections(s, d).groupBy("video_id", "kind").agg(F.count("*").alias("n"), r(F.avg("conf")).alias("conf")), f"WITH {DET} SELECT video_id, kind, count(*) AS n, {R('avg(conf)')} AS conf FROM det GROUP BY 1, 2")
_people = lambda s, d: X.detections(s, d).where("kind = 'person'")
_add("flt4_team_side_filter", lambda s, d: clean.team_side_filter(_people(s, d), F.col("y2") / 0.6, "bottom", 60.0, 3).select("video_id", "frame", "det_id"), f"WITH {DET}, q AS (SELECT video_id, frame, det_id, row_number() OVER (PARTITION BY video_id, frame ORDER BY y2 / 0.6 - 450 DESC, det_id) AS k FROM per WHERE y2 / 0.6 - 450 >= 60.0) SELECT video_id, frame, det_id FROM q WHERE k <= 3")
_add("top1_deepest_six", lambda s, d: clean.team_side_filter(_people(s, d), F.col("y2") / 0.6, "bottom", 0.0, 6).select("video_id", "frame", "det_id"), f"WITH {DET}, q AS (SELECT video_id, frame, det_id, row_number() OVER (PARTITION BY video_id, frame ORDER BY y2 / 0.6 - 450 DESC, det_id) AS k FROM per WHERE y2 / 0.6 - 450 >= 0) SELECT video_id, frame, det_id FROM q WHERE k <= 6")
_BEST = "best AS (SELECT video_id, frame, det_id, x1, y1, x2, y2, conf FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY conf DESC, det_id) AS k FROM det WHERE kind = 'ball') q WHERE k = 1)"
_add("top2_best_ball", lambda s, d: rounded(clean.best_ball(X.detections(s, d))), f"WITH {DET}, {_BEST} SELECT video_id, frame, det_id, {R('x1')} AS x1, {R('y1')} AS y1, {R('x2')} AS x2, {R('y2')} AS y2, {R('conf')} AS conf FROM best")
_add("flt17_conf_class_filter", lambda s, d: X.detections(s, d).where("conf >= 0.25 and kind in ('person', 'ball')").select("video_id", "frame", "kind", "det_id"), f"WITH {DET} SELECT video_id, frame, kind, det_id FROM det WHERE conf >= 0.25 AND kind IN ('person', 'ball')")


def _sources(s, d):
    ball = clean.best_ball(X.detections(s, d)).select("video_id", "frame", ((F.col("x1") + F.col("x2")) / 2).alias("ball_cx"), ((F.col("y1") + F.col("y2")) / 2).alias("ball_cy"))
    return ball.where("frame % 3 <> 0"), ball.where("frame % 2 = 0").withColumn("ball_cx", F.col("ball_cx") + 1)


_add("flt18_ball_source_fallback", lambda s, d: rounded(clean.ball_source_fallback(*_sources(s, d))), f"WITH {DET}, {_BEST} SELECT video_id, frame, {R('(x1 + x2) / 2 + CASE WHEN frame % 3 <> 0 THEN 0 ELSE 1 END')} AS ball_cx, {R('(y1 + y2) / 2')} AS ball_cy, CASE WHEN frame % 3 <> 0 THEN 'first' ELSE 'second' END AS source FROM best WHERE frame % 3 <> 0 OR frame % 2 = 0")
_add("flt14_stride_sample", lambda s, d: clean.stride_sample(positions(s, d), 8).select(*_K), f"WITH {RAW} SELECT match_id, frame_id, slot FROM raw WHERE frame_id % 8 = 0")
_add("flt15_even_sample", lambda s, d: clean.even_sample(positions(s, d), 12).select("match_id", "frame_id").distinct(), f"WITH {RAW}, m AS (SELECT match_id, min(frame_id) AS lo, max(frame_id) AS hi FROM raw GROUP BY 1), g AS (SELECT match_id, CAST(floor(lo + i * (hi - lo) / CAST(11 AS DOUBLE)) AS BIGINT) AS frame_id FROM (SELECT *, unnest(range(0, 12)) AS i FROM m) q) SELECT DISTINCT match_id, frame_id FROM g")
_add("flt6_eval_train_split", lambda s, d: clean.eval_train_split(X.raw_positions(s, d).withColumn("clip", F.floor((F.col("frame_id") - 1) / 41)).withColumn("f", (F.col("frame_id") - 1) % 41 + 1), ("match_id", "clip"), "f").groupBy("match_id", "clip", "part").agg(F.count("*").alias("n")), f"WITH {RAW}, q AS (SELECT match_id, CAST(floor((frame_id - 1) / CAST(41 AS DOUBLE)) AS BIGINT) AS clip, CASE WHEN (frame_id - 1) % 41 + 1 <= 29 THEN 'train' ELSE 'eval' END AS part FROM raw), c AS (SELECT match_id, clip FROM q GROUP BY 1, 2 HAVING count(DISTINCT part) = 2) SELECT q.match_id, q.clip, part, count(*) AS n FROM q JOIN c ON c.match_id = q.match_id AND c.clip = q.clip GROUP BY 1, 2, 3")
_add("flt16_court_bound_filter", lambda s, d: X.raw_positions(s, d).withColumn("x", F.col("x") * 1.4).where(F.col("x").between(-300, 2100) & F.col("y").between(-300, 1200)).select(*_K), f"WITH {RAW} SELECT match_id, frame_id, slot FROM raw WHERE x * 1.4 BETWEEN -300 AND 2100 AND y BETWEEN -300 AND 1200")
_points = lambda s, d: positions(s, d).where("x is not null").withColumn("t_s", F.col("frame_id") / 30)
_HOT = f"{POS}, pt AS (SELECT *, frame_id / CAST(30 AS DOUBLE) AS t_s, floor(x / 30) AS bx, floor(y / 30) AS b2 FROM pres), sp AS (SELECT match_id, max(t_s) - min(t_s) AS span FROM pt GROUP BY 1), bad AS (SELECT pt.match_id, bx, b2 FROM pt JOIN sp ON sp.match_id = pt.match_id GROUP BY 1, 2, 3, span HAVING count(*) >= 15 AND max(t_s) - min(t_s) >= 0.15 * span)"
_add("flt12_static_hotspot_filter", lambda s, d: clean.static_hotspot_filter(_points(s, d), ("match_id",)).select(*_K), f"WITH {_HOT} SELECT match_id, frame_id, slot FROM pt WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.match_id = pt.match_id AND bad.bx = pt.bx AND bad.b2 = pt.b2)")


def _consistency(s, d):
    f = positions(s, d).groupBy(*CLIP_FRAME).agg(F.count("x").alias("n_players"), F.sum("y").alias("sum_y"), F.max("ball_y").alias("ball_y"))
    return rounded(clean.clip_consistency(f, ("match_id", "sequence")).select("match_id", "sequence", "n_player_points", "n_ball_points", "verdict"))


_add("flt13_clip_consistency_filter", _consistency, f"WITH {POS}, f AS (SELECT match_id, sequence, frame_id, count(x) AS n, sum(y) AS sy, max(ball_y) AS b2 FROM pos GROUP BY 1, 2, 3), c AS (SELECT match_id, sequence, CAST(sum(n) AS BIGINT) AS n_player_points, count(b2) AS n_ball_points, avg(b2) AS bm, sum(sy) / sum(n) AS pm FROM f GROUP BY 1, 2) SELECT match_id, sequence, n_player_points, n_ball_points, CASE WHEN n_player_points < 3 OR n_ball_points < 3 THEN 'sparse' WHEN (bm - 450) * (pm - 450) < 0 THEN 'inconsistent' ELSE 'kept' END AS verdict FROM c")


def _ablation(s, d):
    det = X.detections(s, d)
    frames = X.raw_positions(s, d).select(F.col("match_id").alias("video_id"), F.col("frame_id").alias("frame")).distinct()
    per = det.where("conf >= 0.25").groupBy("video_id", "frame").agg(F.count(F.when(F.col("kind") == "person", 1)).alias("n"), F.max(F.when(F.col("kind") == "ball", 1).otherwise(0)).alias("ball"))
    both = frames.join(per, ["video_id", "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ball", F.coalesce("ball", F.lit(0)))
    return rounded(both.groupBy("video_id").agg(F.avg("n").alias("players_per_frame"), F.percentile("n", F.lit(0.5)).alias("median_players"), F.avg("ball").alias("ball_recall"), F.count("*").alias("n_frames")))


_ABL = f"{DET}, fr2 AS (SELECT DISTINCT match_id AS video_id, frame_id AS frame FROM raw), pf AS (SELECT video_id, frame, count(CASE WHEN kind = 'person' THEN 1 END) AS n, max(CASE WHEN kind = 'ball' THEN 1 ELSE 0 END) AS ball FROM det WHERE conf >= 0.25 GROUP BY 1, 2), j AS (SELECT f.video_id, coalesce(n, 0) AS n, coalesce(ball, 0) AS ball FROM fr2 f LEFT JOIN pf ON pf.video_id = f.video_id AND pf.frame = f.frame)"
_add("agg23_source_ablation", _ablation, f"WITH {_ABL} SELECT video_id, {R('avg(n)')} AS players_per_frame, {R('quantile_cont(n, 0.5)')} AS median_players, {R('avg(ball)')} AS ball_recall, count(*) AS n_frames FROM j GROUP BY 1")
_add("jn13_frame_dim_left_join", lambda s, d: _ablation(s, d).select("video_id", "n_frames", "players_per_frame"), f"WITH {_ABL} SELECT video_id, count(*) AS n_frames, {R('avg(n)')} AS players_per_frame FROM j GROUP BY 1")
_add("top5_frame_range", lambda s, d: positions(s, d).where(F.col("frame_id").between(50, 149)).select(*_K), f"WITH {RAW} SELECT match_id, frame_id, slot FROM raw WHERE frame_id >= 50 AND frame_id < 150")


def _health(s, d):
    p = positions(s, d)
    f = p.groupBy(*CLIP_FRAME).agg(F.max("ball_x").alias("ball_x"), F.max("ball_y").alias("ball_y"), F.count("x").alias("n"))
    c = f.groupBy("match_id").agg(F.count("*").alias("n_frames"), F.avg(F.col("ball_x").isNull().cast("double")).alias("ball_missing"), F.min("ball_y").alias("ball_y_min"), F.max("ball_y").alias("ball_y_max"), F.avg("ball_y").alias("ball_y_mean"), F.avg("n").alias("players_per_frame"))
    return rounded(c)


_add("agg24_data_health", _health, f"WITH {POS}, f AS (SELECT match_id, frame_id, max(ball_x) AS bx, max(ball_y) AS b2, count(x) AS n FROM pos GROUP BY 1, 2) SELECT match_id, count(*) AS n_frames, {R('avg(CASE WHEN bx IS NULL THEN 1.0 ELSE 0.0 END)')} AS ball_missing, {R('min(b2)')} AS ball_y_min, {R('max(b2)')} AS ball_y_max, {R('avg(b2)')} AS ball_y_mean, {R('avg(n)')} AS players_per_frame FROM f GROUP BY 1")
