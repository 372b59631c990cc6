"""Queries of formation and movement: frames, windows and clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FRAME_CHANNELS, KINEMATIC_CHANNELS
from ..operators import clean, clips, frames
from .base import BOTH, CLIP_FRAME, MOVES, PAIRS, POS, Query, R, descriptors, frame_channels, moves, positions, r, rounded

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_cols = lambda names: ", ".join(f"{R(c)} AS {c}" for c in names)

_add("agg1_team_descriptor", lambda s, d: rounded(descriptors(s, d)), f"WITH {PAIRS} SELECT match_id, sequence, frame_id, {_cols(FRAME_CHANNELS)} FROM descr")
_add("win1_slot_velocity", lambda s, d: rounded(moves(s, d), *CLIP_FRAME, "slot", "vx", "vy", "speed"), f"WITH {MOVES} SELECT match_id, sequence, frame_id, slot, {_cols(('vx', 'vy', 'speed'))} FROM mov")
_add("agg2_kinematic_descriptor", lambda s, d: rounded(frames.kinematics(moves(s, d)), *CLIP_FRAME, *KINEMATIC_CHANNELS), f"WITH {MOVES} SELECT match_id, sequence, frame_id, {_cols(KINEMATIC_CHANNELS)} FROM kin")
_add("agg3_sync_score", lambda s, d: rounded(frames.sync_score(frames.kinematics(moves(s, d)))), f"WITH {MOVES}, c AS (SELECT match_id, sequence, avg(c) AS v FROM cosp GROUP BY 1, 2) SELECT DISTINCT b.match_id, b.sequence, {R('coalesce(v, 0)')} AS sync_score FROM base b LEFT JOIN c ON c.match_id = b.match_id AND c.sequence = b.sequence")
_STEPS = "steps AS (SELECT *, CASE WHEN n_present > 0 AND lag(n_present) OVER w > 0 THEN sqrt((centroid_x - lag(centroid_x) OVER w) * (centroid_x - lag(centroid_x) OVER w) + (centroid_y - lag(centroid_y) OVER w) * (centroid_y - lag(centroid_y) OVER w)) END AS centroid_step FROM descr WINDOW w AS (PARTITION BY match_id, sequence ORDER BY frame_id))"
_add("win3_centroid_velocity", lambda s, d: rounded(frames.centroid_steps(descriptors(s, d)), *CLIP_FRAME, "centroid_step"), f"WITH {PAIRS}, {_STEPS} SELECT match_id, sequence, frame_id, {R('centroid_step')} AS centroid_step FROM steps")
_WINDOW = f"""{BOTH}, {_STEPS},
w1 AS (SELECT match_id, sequence, count(*) AS n_frames, coalesce(avg(centroid_step), 0) AS centroid_vel_cm_per_frame, coalesce(avg(CASE WHEN n_present >= 2 THEN spread_x * spread_x + spread_y * spread_y END), 0) AS var_spatial_cm2, min(frame_id) AS f0 FROM steps GROUP BY 1, 2),
w2 AS (SELECT match_id, sequence, avg(nn) AS mean_spacing_cm FROM near GROUP BY 1, 2),
w3 AS (SELECT match_id, sequence, avg(c) AS sync_score FROM cosp GROUP BY 1, 2),
w4 AS (SELECT k.match_id, k.sequence, avg(speed_top2) AS t2, avg(speed_bot4) AS b4 FROM kin k JOIN w1 ON w1.match_id = k.match_id AND w1.sequence = k.sequence WHERE k.frame_id > f0 GROUP BY 1, 2),
wm AS (SELECT w1.match_id, w1.sequence, n_frames, coalesce(sync_score, 0) AS sync_score, coalesce(mean_spacing_cm, 0) AS mean_spacing_cm, centroid_vel_cm_per_frame, var_spatial_cm2, coalesce(t2, 0) AS speed_top2_cm_frame, coalesce(b4, 0) AS speed_bot4_cm_frame, coalesce(t2, 0) - coalesce(b4, 0) AS speed_diff_cm_frame
  FROM w1 LEFT JOIN w2 ON w2.match_id = w1.match_id AND w2.sequence = w1.sequence LEFT JOIN w3 ON w3.match_id = w1.match_id AND w3.sequence = w1.sequence LEFT JOIN w4 ON w4.match_id = w1.match_id AND w4.sequence = w1.sequence)"""
_METRICS = ("sync_score", "mean_spacing_cm", "centroid_vel_cm_per_frame", "var_spatial_cm2", "speed_top2_cm_frame", "speed_bot4_cm_frame", "speed_diff_cm_frame")
_add("agg4_window_metrics", lambda s, d: rounded(frames.window_metrics(frame_channels(s, d))), f"WITH {_WINDOW} SELECT match_id, sequence, n_frames, {_cols(_METRICS)} FROM wm")
_add("agg6_per_player_speed", lambda s, d: rounded(frames.per_player_speed(moves(s, d))), f"WITH {MOVES} SELECT match_id, sequence, slot, {R('avg(CASE WHEN speed <= 50 THEN speed END) * 30')} AS speed_cm_s FROM mov GROUP BY 1, 2, 3")
_add("flt11_speed_caps", lambda s, d: rounded(moves(s, d).withColumn("capped", clean.cap_steps(F.col("speed"))), *CLIP_FRAME, "slot", "capped"), f"WITH {MOVES} SELECT match_id, sequence, frame_id, slot, {R('CASE WHEN speed <= 50 THEN speed END')} AS capped FROM mov")
_FILL = f"""{POS},
seen AS (SELECT *, CASE WHEN x IS NOT NULL THEN frame_id END AS f FROM pos),
ends AS (SELECT *, max(f) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fa, min(f) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fb FROM seen WINDOW w AS (PARTITION BY match_id, sequence, slot ORDER BY frame_id)),
filled AS (SELECT e.match_id, e.sequence, e.frame_id, e.slot, e.x IS NULL AND fa IS NOT NULL AND fb IS NOT NULL AND fb - fa - 1 <= 15 AS filled, e.x AS ox, e.y AS oy, fa, fb, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bq
  FROM ends e LEFT JOIN pos a ON a.match_id = e.match_id AND a.slot = e.slot AND a.frame_id = fa LEFT JOIN pos b ON b.match_id = e.match_id AND b.slot = e.slot AND b.frame_id = fb)"""
_add("win2_gap_interpolate", lambda s, d: rounded(frames.interpolate_gaps(positions(s, d)), *CLIP_FRAME, "slot", "x", "y", "filled"), f"WITH {_FILL} SELECT match_id, sequence, frame_id, slot, {R('CASE WHEN filled THEN ax + (bx - ax) * (frame_id - fa) / (fb - fa) ELSE ox END')} AS x, {R('CASE WHEN filled THEN ay + (bq - ay) * (frame_id - fa) / (fb - fa) ELSE oy END')} AS y, filled FROM filled")
_add("stf9_count_window", lambda s, d: frames.whole_windows(positions(s, d)).select(*CLIP_FRAME).distinct(), f"WITH {POS}, n AS (SELECT match_id, sequence FROM base GROUP BY 1, 2 HAVING count(*) = 29) SELECT b.match_id, b.sequence, b.frame_id FROM base b JOIN n ON n.match_id = b.match_id AND n.sequence = b.sequence")
_add("flt8_activity_gate", lambda s, d: rounded(frames.activity_gate(moves(s, d))), f"WITH {MOVES}, g AS (SELECT match_id, sequence, coalesce(avg(speed), 0) AS ms, count(x) / CAST(count(DISTINCT frame_id) AS DOUBLE) AS np FROM mov GROUP BY 1, 2) SELECT match_id, sequence, {R('ms')} AS gate_mean_speed_cm_frame, {R('np')} AS gate_players_present, ms < 2.0 OR np < 3.0 AS dead_ball FROM g")
_add("win7_top2_bot4_rank", lambda s, d: rounded(clips.speed_ranks(moves(s, d))), f"WITH {MOVES} SELECT match_id, sequence, frame_id, slot, {R('speed')} AS speed, row_number() OVER (PARTITION BY match_id, frame_id ORDER BY speed DESC, slot) AS rank FROM ranked")
_CH = FRAME_CHANNELS + KINEMATIC_CHANNELS
_LONG = "chan AS (" + " UNION ALL ".join(f"SELECT d.match_id, d.sequence, d.frame_id, '{c}' AS channel, {'d' if c in FRAME_CHANNELS else 'k'}.{c} AS v FROM descr d JOIN kin k ON k.match_id = d.match_id AND k.frame_id = d.frame_id" for c in _CH) + ")"
_ABS = "stats AS (SELECT match_id, sequence, channel, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, coalesce(regr_slope(v, frame_id), 0) AS slope, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM chan GROUP BY 1, 2, 3)"
_SIX = ("mean", "std", "min", "max", "slope", "iqr")


def _channels(s, d):
    return clips.channels(frame_channels(s, d), _CH)


_add("agg7_absolute_features", lambda s, d: rounded(clips.absolute_features(frame_channels(s, d)), digits=5), f"WITH {BOTH}, {_LONG}, {_ABS} SELECT match_id, sequence, channel, " + ", ".join(f"(round({c}, 5) + CAST(0 AS DOUBLE)) AS {c}" for c in _SIX) + " FROM stats")
_add("win8_zscore_clip", lambda s, d: rounded(clips.zscored_channels(frame_channels(s, d), _CH), digits=5), f"WITH {BOTH}, {_LONG}, z AS (SELECT *, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd, count(*) OVER w AS n FROM chan WINDOW w AS (PARTITION BY match_id, sequence, channel)) SELECT match_id, sequence, frame_id, channel, (round(v, 5) + CAST(0 AS DOUBLE)) AS v, (round(CASE WHEN n < 2 OR sd < 1e-6 THEN 0 ELSE (v - mu) / sd END, 5) + CAST(0 AS DOUBLE)) AS z FROM z")
_RATIO = "ratio AS (" + " UNION ALL ".join(f"SELECT d.match_id, d.sequence, d.frame_id, '{n}' AS channel, greatest(-50, least(50, {a} / (abs({b}) + 1e-6))) AS v FROM descr d JOIN kin k ON k.match_id = d.match_id AND k.frame_id = d.frame_id" for n, (a, b) in clips.RATIOS.items()) + " UNION ALL " + " UNION ALL ".join(f"SELECT match_id, sequence, frame_id, channel, v FROM chan WHERE channel = '{c}'" for c in clips.DIMENSIONLESS) + ")"
_INV = f"""{BOTH}, {_LONG}, {_ABS}, {_RATIO},
rs AS (SELECT match_id, sequence, channel, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, coalesce(regr_slope(v, frame_id), 0) AS slope, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM ratio GROUP BY 1, 2, 3),
zs AS (SELECT match_id, sequence, channel, CASE WHEN std < 1e-6 THEN 0 ELSE (min - mean) / std END AS zmin, CASE WHEN std < 1e-6 THEN 0 ELSE (max - mean) / std END AS zmax, CASE WHEN std < 1e-6 THEN 0 ELSE slope / std END AS zslope, CASE WHEN std < 1e-6 THEN 0 ELSE iqr / std END AS ziqr FROM stats),
inv AS (""" + " UNION ALL ".join([f"SELECT match_id, sequence, channel || '__{c}' AS feature, {c} AS value FROM rs" for c in _SIX] + [f"SELECT match_id, sequence, channel || '__z_{c}' AS feature, z{c} AS value FROM zs" for c in ("min", "max", "slope", "iqr")]) + ")"
_add("agg8_invariant_features", lambda s, d: rounded(clips.invariant_features(frame_channels(s, d)), digits=4), f"WITH {_INV} SELECT match_id, sequence, feature, (round(value, 4) + CAST(0 AS DOUBLE)) AS value FROM inv")
_NAMES = "names AS (SELECT unnest(range(0, 240)) AS place, unnest(range(0, 240)) < 108 AS plain, unnest([" + ", ".join(f"'{n}'" for n in clips.feature_names()) + "]) AS feature)"
_ALL = f"{_INV}, {_NAMES}, u AS (" + " UNION ALL ".join(f"SELECT match_id, sequence, channel || '__{c}' AS feature, {c} AS value, true AS plain FROM stats" for c in _SIX) + " UNION ALL SELECT match_id, sequence, feature, value, false FROM inv)"


def _features(s, d):
    """All 240 values of each clip with their places; rounded as in agg7 and agg8."""
    rows = clips.feature_vector(frame_channels(s, d)).select("match_id", "sequence", F.posexplode("features").alias("place", "value"))
    return rows.withColumn("value", F.when(F.col("place") < 108, r("value", 5)).otherwise(r("value", 4)))


_add("agg9_feature_mode_union", _features, f"WITH {_ALL} SELECT match_id, sequence, CAST(place AS INTEGER) AS place, (CASE WHEN plain THEN round(value, 5) ELSE round(value, 4) END + CAST(0 AS DOUBLE)) AS value FROM u JOIN names USING (feature, plain)")
_padded = lambda s, d: clips.pad_windows(frame_channels(s, d).select(*CLIP_FRAME, *_CH))
_add("arr2_pad_truncate", lambda s, d: rounded(_padded(s, d), digits=5), f"WITH {BOTH}, w AS (SELECT match_id, sequence, min(frame_id) AS f0 FROM descr GROUP BY 1, 2), g AS (SELECT match_id, sequence, f0, CAST(unnest(range(0, 29)) AS BIGINT) AS t FROM w) SELECT g.match_id, g.sequence, g.t, " + ", ".join(f"(round(coalesce({'d' if c in FRAME_CHANNELS else 'k'}.{c}, 0), 5) + CAST(0 AS DOUBLE)) AS {c}" for c in _CH) + " FROM g LEFT JOIN descr d ON d.match_id = g.match_id AND d.sequence = g.sequence AND d.frame_id = f0 + t LEFT JOIN kin k ON k.match_id = g.match_id AND k.sequence = g.sequence AND k.frame_id = f0 + t")
