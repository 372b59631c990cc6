"""Queries of clip measures, augmentation, class names, smoothing and checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import clean, frames, measures, pose, rules, scores
from ..operators.stored import stored
from .base import CLIP_FRAME, POS, Query, R, moves, positions, rounded
from .scoring import SQL, predictions

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_LAG = f"""{POS}, bl AS (SELECT match_id, sequence, frame_id, max(ball_x) AS bx, max(ball_y) AS b2 FROM pos GROUP BY 1, 2, 3),
b1 AS (SELECT *, row_number() OVER w - 1 AS i, b2 - lag(b2) OVER w AS dy FROM bl WINDOW w AS (PARTITION BY match_id, sequence ORDER BY frame_id)),
b3 AS (SELECT *, lag(dy) OVER (PARTITION BY match_id, sequence ORDER BY frame_id) AS dy0 FROM b1),
im AS (SELECT match_id, sequence, min(CASE WHEN dy0 * dy <= 0 THEN i - 1 END) AS impact, count(b2) AS n FROM b3 GROUP BY 1, 2),
ta AS (SELECT b.match_id, b.sequence, b.frame_id, impact, bx, b2 FROM b3 b JOIN im ON im.match_id = b.match_id AND im.sequence = b.sequence AND b.i = impact WHERE n >= 3 AND bx IS NOT NULL),
nr AS (SELECT p.match_id, p.sequence, slot, impact, row_number() OVER (PARTITION BY p.match_id, p.sequence ORDER BY sqrt((x - bx) * (x - bx) + (y - b2) * (y - b2)), slot) AS k FROM pos p JOIN ta ON ta.match_id = p.match_id AND ta.frame_id = p.frame_id WHERE x IS NOT NULL),
st AS (SELECT match_id, sequence, slot, row_number() OVER w - 2 AS i, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM pos WINDOW w AS (PARTITION BY match_id, sequence, slot ORDER BY frame_id)),
pk AS (SELECT match_id, sequence, slot, i AS peak, row_number() OVER (PARTITION BY match_id, sequence, slot ORDER BY step DESC, i) AS k FROM st WHERE step IS NOT NULL),
lg AS (SELECT n.match_id, n.sequence, CAST(peak - impact AS DOUBLE) AS lag_ FROM nr n JOIN pk ON pk.match_id = n.match_id AND pk.sequence = n.sequence AND pk.slot = n.slot AND pk.k = 1 WHERE n.k = 1)"""
_add("ana7_reaction_lag", lambda s, d: measures.reaction_lag(positions(s, d)), f"WITH {_LAG} SELECT DISTINCT p.match_id, p.sequence, lag_ AS reaction_lag_frames FROM pos p LEFT JOIN lg ON lg.match_id = p.match_id AND lg.sequence = p.sequence")
_add("ana6_clip_metrics", lambda s, d: measures.clip_metrics(positions(s, d)))
_U = lambda key, part: f"(CAST('0x' || substr(md5({key}), {8 * part + 1}, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"
_G = lambda key, turn: f"sqrt(-2 * ln(1 - {_U(key, 0)})) * {turn}(2 * pi() * {_U(key, 1)})"
_CLIP_KEY = "'7:' || match_id || ':' || sequence"
_SLOT_KEY, _BALL_KEY = f"{_CLIP_KEY} || ':' || frame_id || ':' || slot", f"{_CLIP_KEY} || ':' || frame_id || ':ball'"
_MOVED = ", ".join(f"{c} + 15 * {_G(key, turn)} AS {c}" for c, key, turn in (("x", _SLOT_KEY, "cos"), ("y", _SLOT_KEY, "sin"), ("ball_x", _BALL_KEY, "cos"), ("ball_y", _BALL_KEY, "sin")))
_AUG = f"WITH {POS}, au AS (SELECT match_id, sequence, frame_id, slot, {_U(_CLIP_KEY, 0)} < 0.5 AS mirrored, {_MOVED} FROM pos) SELECT match_id, sequence, frame_id, slot, mirrored, {R('CASE WHEN mirrored THEN 1800 - x ELSE x END')} AS x, {R('y')} AS y, {R('CASE WHEN mirrored THEN 1800 - ball_x ELSE ball_x END')} AS ball_x, {R('ball_y')} AS ball_y FROM au"
_add("prj3_augment", lambda s, d: rounded(measures.augment(positions(s, d)).select(*CLIP_FRAME, "slot", "mirrored", "x", "y", "ball_x", "ball_y")), _AUG)
_add("flt7_class_filter", lambda s, d: measures.class_filter(predictions(s, d).select("clip", F.col("y_true").alias("label")), ("Coordinated Attack", "Defense"), {"Coordinated Defense": "Defense"}), f"WITH {SQL} SELECT clip, CASE WHEN y_true = 'Coordinated Defense' THEN 'Defense' ELSE y_true END AS label FROM p WHERE y_true IN ('Coordinated Attack', 'Coordinated Defense')")
_CLS = "SELECT CASE WHEN c_custkey % 11 = 0 THEN 1000 + c_custkey ELSE c_custkey % 40 END AS model, c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'Player' WHEN 1 THEN 'volleyball' WHEN 2 THEN 'person ' WHEN 3 THEN 'Athlete' WHEN 4 THEN 'ball player' WHEN 5 THEN 'referee' ELSE 'net' END AS name FROM {customer}"
_add("scl7_class_id_resolve", lambda s, d: measures.resolve_classes(s.sql(_CLS, **X.tables(s, d, "customer"))), f"WITH c AS (SELECT model, id, lower(trim(name)) AS name FROM ({_CLS.replace('{', '').replace('}', '')})) SELECT model, coalesce(min(CASE WHEN name IN ('person', 'player', 'players', 'people', 'human', 'athlete') THEN id END), CASE WHEN count(*) = 1 THEN min(id) END) AS person_id, min(CASE WHEN name LIKE '%ball%' THEN id END) AS ball_id FROM c GROUP BY 1")


def _ema(s, d):
    b = positions(s, d).groupBy(*CLIP_FRAME).agg(F.max("ball_x").alias("v"))
    return rounded(measures.smoothed_hits(b, "v", 0.75, ("match_id", "sequence")).select(*CLIP_FRAME, "ema"))


_add("stf8_quad_ema", _ema, f"WITH {POS}, b AS (SELECT match_id, sequence, frame_id, max(ball_x) AS v FROM pos GROUP BY 1, 2, 3), c AS (SELECT *, count(v) OVER (PARTITION BY match_id, sequence ORDER BY frame_id) AS k FROM b), h AS (SELECT * FROM c WHERE v IS NOT NULL), e AS (SELECT a.match_id, a.sequence, a.k, sum(z.v * power(0.75, a.k - z.k) * CASE WHEN z.k = 1 THEN 1 ELSE 0.25 END) AS ema FROM h a JOIN h z ON z.match_id = a.match_id AND z.sequence = a.sequence AND z.k <= a.k GROUP BY 1, 2, 3) SELECT c.match_id, c.sequence, c.frame_id, {R('ema')} AS ema FROM c LEFT JOIN e ON e.match_id = c.match_id AND e.sequence = c.sequence AND e.k = c.k")


def _onsets(s, d):
    m = moves(s, d).where("slot = 1").withColumn("fast", F.coalesce(F.col("speed") > 30, F.lit(False)))
    return m.withColumn("onset", measures.onset(F.col("fast"), W.partitionBy("match_id", "sequence", "slot").orderBy("frame_id"))).select(*CLIP_FRAME, "onset")


_add("win15_onset_flag", _onsets, f"WITH {POS}, v AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) > 30, false) AS fast FROM pos WHERE slot = 1 WINDOW w AS (PARTITION BY match_id, sequence ORDER BY frame_id)) SELECT match_id, sequence, frame_id, fast AND NOT coalesce(lag(fast) OVER (PARTITION BY match_id, sequence ORDER BY frame_id), false) AS onset FROM v")


def _checks(s, d):
    raw = stored(X.raw_positions(s, d), "raw")  # read by three checks
    at = clean.clean_positions(raw)
    return measures.checks([("descriptor without nulls", frames.team_descriptor(clean.with_players(at)), "hull_area is not null and n_present between 0 and 6"), ("speeds are not negative", frames.slot_velocity(at), "speed is null or speed >= 0"), ("every clip is labelled", rules.label_clips(raw), "label is not null"), ("accuracy is a share", scores.classification_scores(predictions(s, d)), "accuracy between 0 and 1")])


_add("ana18_expectation_checks", _checks)


def _keypoints(s, d):
    """Skeletons around the boxes: hips, shoulders and wrists that move with frame and slot."""
    det = X.detections(s, d).where("kind = 'person'").withColumn("track_id", F.col("det_id").cast("long"))
    t, cx = F.col("frame") + F.col("det_id"), (F.col("x1") + F.col("x2")) / 2
    point = lambda x, y, c: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (c / 10).alias("conf"))
    blank = point(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    hip = point(cx, F.col("y2") - 30 - 6 * (t % 3), t % 10)
    shoulder, wrist = point(cx, F.col("y1") + 10, t % 10 + 3), point(cx + 20 * (t % 4 - 1.5), F.col("y1") + 10 + 15 * (t % 5 - 2), t % 10 + 2)
    kp = F.array(*[blank] * 5, shoulder, shoulder, blank, blank, wrist, wrist, hip, hip, *[blank] * 4)
    return det.select("video_id", "frame", "track_id", F.struct("x1", "y1", "x2", "y2").alias("box"), kp.alias("kp"))


_add("ana25_pose_biomech", lambda s, d: rounded(pose.pose_events(pose.pose_motion(_keypoints(s, d)))))
_add("stf6_pose_ema", lambda s, d: rounded(pose.pose_motion(_keypoints(s, d))))
_add("agg29_pose_frame_summary", lambda s, d: rounded(pose.pose_frames(pose.pose_motion(_keypoints(s, d)))))
_add("win16_lagged_angle_speed", lambda s, d: rounded(pose.pose_motion(_keypoints(s, d)).select("video_id", "frame", "track_id", "arm_omega_rad_s")))
