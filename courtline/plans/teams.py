"""Queries of roles, identity, teams, checks and novelty."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..constants import FPS
from ..functions import geometry as G
from ..operators import clean, frames, identity, roles, rules, teams
from ..streaming import ordered
from ..streaming.replay import cut, replayed
from .base import MOVES, POS, RAW, Query, R, frame_channels, moves, positions, rounded
from .geometry import DET

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_KIN = f"""{MOVES}, sk AS (SELECT match_id, sequence, slot, count(x) / CAST(count(*) AS DOUBLE) AS valid_frac, count(x) AS seen, avg(y - 450) AS nm, min(y - 450) AS nmin,
  coalesce(quantile_cont(CASE WHEN speed * 30 <= 800 THEN speed * 30 END, 0.95), 0) AS vmax,
  coalesce(quantile_cont(CASE WHEN speed * 30 <= 800 THEN greatest(-vy * 30, 0) END, 0.95), 0) AS app,
  coalesce(quantile_cont(CASE WHEN speed * 30 <= 800 THEN abs(vx * 30) END, 0.95), 0) AS lat,
  coalesce(sum(abs(vx)), 0) AS ax, coalesce(sum(abs(vy)), 0) AS ay, coalesce(sum(CASE WHEN speed * 30 <= 800 THEN speed END), 0) AS disp FROM mov GROUP BY 1, 2, 3),
kn AS (SELECT match_id, sequence, slot, valid_frac, CASE WHEN seen >= 2 THEN nm END AS net_dist_mean, CASE WHEN seen >= 2 THEN nmin END AS net_dist_min, CASE WHEN seen >= 2 THEN vmax ELSE 0 END AS vmax, CASE WHEN seen >= 2 THEN app ELSE 0 END AS approach_speed, CASE WHEN seen >= 2 THEN lat ELSE 0 END AS lateral_speed, CASE WHEN seen >= 2 AND ax + ay > 0 THEN ax / (ax + ay) ELSE 0 END AS lateral_ratio, CASE WHEN seen >= 2 THEN disp ELSE 0 END AS displacement FROM sk)"""
_KC = ("valid_frac", "net_dist_mean", "net_dist_min", "vmax", "approach_speed", "lateral_speed", "lateral_ratio", "displacement")
_list = lambda cs: ", ".join(f"{R(c)} AS {c}" for c in cs)
_add("ana10_slot_kinematics", lambda s, d: rounded(roles.slot_kinematics(moves(s, d))), f"WITH {_KIN} SELECT match_id, sequence, slot, {_list(_KC)} FROM kn")
_nrm = lambda c: f"CASE WHEN max({c}) OVER w > 0 THEN {c} / max({c}) OVER w ELSE 0 END"
_ROLE = f"""{_KIN}, nz AS (SELECT *, {_nrm('approach_speed')} AS a, {_nrm('lateral_speed')} AS l, {_nrm('displacement')} AS d FROM kn WINDOW w AS (PARTITION BY match_id, sequence)),
s0 AS (SELECT *, CASE WHEN valid_frac >= 0.4 AND net_dist_mean IS NOT NULL THEN 1 ELSE 0 END AS u, CASE WHEN net_dist_mean >= 240 THEN 1 ELSE 0 END AS back FROM nz),
s1 AS (SELECT *, CASE WHEN u = 1 THEN a * CASE WHEN net_dist_min <= 150 THEN 1.0 ELSE 0.4 END ELSE 0 END AS attacker, CASE WHEN u = 1 THEN CASE WHEN net_dist_mean <= 160 THEN 1.0 ELSE 0.2 END * (1 - 0.8 * d) ELSE 0 END AS set0,
  CASE WHEN u = 1 THEN CASE WHEN back = 1 THEN 1.0 ELSE 0.1 END * l * (0.5 + 0.5 * lateral_ratio) ELSE 0 END AS lib0, CASE WHEN u = 1 THEN CASE WHEN back = 1 THEN 0.7 ELSE 0.2 END * (1 - 0.6 * a) ELSE 0 END AS defender FROM s0),
s2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY match_id, sequence ORDER BY set0 DESC, slot) = 1 THEN set0 ELSE 0 END AS setter, CASE WHEN row_number() OVER (PARTITION BY match_id, sequence ORDER BY lib0 DESC, slot) = 1 THEN lib0 ELSE 0 END AS libero FROM s1),
s3 AS (SELECT *, greatest(attacker, setter, libero, defender) AS top, list_sort([attacker, setter, libero, defender])[3] AS second FROM s2),
rl AS (SELECT *, top - second AS margin, CASE WHEN valid_frac < 0.4 OR top <= 0 OR top - second < 0.1 THEN 'unknown' WHEN attacker = top THEN 'attacker' WHEN setter = top THEN 'setter' WHEN libero = top THEN 'libero' ELSE 'defender' END AS role FROM s3)"""
_RC = ("attacker", "setter", "libero", "defender")
_add("win9_slot_norm", lambda s, d: rounded(roles.slot_kinematics(moves(s, d)).withColumn("share", roles.slot_norm("approach_speed")).select("match_id", "sequence", "slot", "share")), f"WITH {_ROLE} SELECT match_id, sequence, slot, {R('a')} AS share FROM nz")
_add("win10_role_exclusive", lambda s, d: rounded(roles.role_scores(roles.slot_kinematics(moves(s, d))).select("match_id", "sequence", "slot", *_RC)), f"WITH {_ROLE} SELECT match_id, sequence, slot, {_list(_RC)} FROM s2")
_add("win11_role_margin", lambda s, d: rounded(roles.infer_roles(moves(s, d)).select("match_id", "sequence", "slot", "margin")), f"WITH {_ROLE} SELECT match_id, sequence, slot, {R('margin')} AS margin FROM rl")
_add("ana11_infer_roles", lambda s, d: roles.infer_roles(moves(s, d)).select("match_id", "sequence", "slot", "role"), f"WITH {_ROLE} SELECT match_id, sequence, slot, role FROM rl")
_SUM = f"{_ROLE}, sm AS (SELECT match_id, sequence, " + ", ".join(f"count(CASE WHEN role = '{r}' THEN 1 END) AS n_{r}" for r in (*roles.ROLES, "unknown")) + ", max(vmax) AS max_vmax, max(CASE WHEN role = 'attacker' THEN approach_speed END) AS attacker_approach, max(CASE WHEN role = 'libero' THEN lateral_speed END) AS libero_lateral, min(CASE WHEN role = 'setter' THEN displacement END) AS setter_displacement FROM rl GROUP BY 1, 2)"
_summary = lambda s, d: roles.role_summary(roles.infer_roles(moves(s, d)))
_add("agg27_role_summary", lambda s, d: rounded(_summary(s, d)), f"WITH {_SUM} SELECT match_id, sequence, n_attacker, n_setter, n_libero, n_defender, n_unknown, {_list(('max_vmax', 'attacker_approach', 'libero_lateral', 'setter_displacement'))} FROM sm")
_add("agg30_band_share", lambda s, d: rounded(roles.band_share(_summary(s, d))), f"WITH {_SUM} SELECT {R('avg(CASE WHEN attacker_approach BETWEEN 200 AND 400 THEN 1.0 ELSE 0.0 END)')} AS share, {R('avg(attacker_approach)')} AS mean, count(*) AS n_clips FROM sm WHERE attacker_approach IS NOT NULL")
_add("ana12_role_by_tactic", lambda s, d: rounded(_summary(s, d).join(rules.label_clips(X.raw_positions(s, d)), ["match_id", "sequence"]).groupBy("label").agg(F.avg("n_attacker").alias("n_attacker"), F.avg("max_vmax").alias("max_vmax"), F.avg("attacker_approach").alias("attacker_approach"), F.count("*").alias("n_clips"))))
_shuffled = lambda s, d: positions(s, d).withColumn("slot", ((F.col("slot") + F.col("frame_id")) % 6 + 1).cast("int"))
_add("stf1_recover_identity", lambda s, d: rounded(identity.recover_identity(_shuffled(s, d))))


def _feet(s, d):
    return X.detections(s, d).where("kind = 'person'").select("video_id", "frame", "det_id", "track_id", ((F.col("x1") + F.col("x2")) / 1.2).alias("x"), (F.col("y2") / 0.6).alias("y"))


_add("stf2_slot_manager", lambda s, d: rounded(identity.manage_slots(_feet(s, d))))
_balls = lambda s, d: positions(s, d).groupBy(F.col("match_id").alias("video_id"), F.col("frame_id").alias("frame")).agg(F.max("ball_x").alias("ball_x"), F.max("ball_y").alias("ball_y"))
_BALL = f"""WITH RECURSIVE {POS}, fr AS (SELECT match_id AS video_id, frame_id AS frame, max(ball_x) AS x, max(ball_y) AS y FROM pos GROUP BY 1, 2),
seen AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS k, least(frame - lag(frame) OVER w - 1, 12) AS m, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM fr WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
vel AS (SELECT video_id, k, CAST(0 AS DOUBLE) AS vx, CAST(0 AS DOUBLE) AS vy FROM seen WHERE k = 1
  UNION ALL SELECT s.video_id, s.k, 0.55 * (s.dx - vx * s.m) + 0.45 * vx, 0.55 * (s.dy - vy * s.m) + 0.45 * vy FROM vel v JOIN seen s ON s.video_id = v.video_id AND s.k = v.k + 1),
sight AS (SELECT s.video_id, s.frame AS since, s.x, s.y, vx, vy FROM seen s JOIN vel v ON v.video_id = s.video_id AND v.k = s.k)
SELECT f.video_id, f.frame, CASE WHEN f.frame - since <= 12 THEN {R('a.x + vx * (f.frame - since)')} END AS ball_x, CASE WHEN f.frame - since <= 12 THEN {R('a.y + vy * (f.frame - since)')} END AS ball_y, coalesce(f.frame - since BETWEEN 1 AND 12, false) AS predicted
FROM fr f ASOF LEFT JOIN sight a ON a.video_id = f.video_id AND a.since <= f.frame"""
_add("stf3_ball_tracker", lambda s, d: rounded(identity.track_ball(_balls(s, d))), _BALL)
_team = lambda s, d: _feet(s, d).withColumn("team", G.geometric_team(F.col("y") - 200 * (F.col("frame") % 3), 0.0))
_VOTE = f"""{DET}, ft AS (SELECT video_id, frame, det_id, track_id, y2 / 0.6 AS y, CASE WHEN y2 / 0.6 - 200 * (frame % 3) >= 450 THEN 1 ELSE 0 END AS nr, CASE WHEN y2 / 0.6 - 200 * (frame % 3) >= 450 THEN 0 WHEN y2 / 0.6 - 200 * (frame % 3) <= 450 THEN 1 ELSE 0 END AS fr FROM per),
gp AS (SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 THEN 0 ELSE 1 END AS nw FROM ft WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
rn AS (SELECT *, sum(nw) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS run FROM gp),
kk AS (SELECT *, frame - first_value(frame) OVER (PARTITION BY video_id, track_id, run ORDER BY frame) AS k FROM rn),
vt AS (SELECT *, sum(nr * power(0.98, -k)) OVER w * power(0.98, k) AS near, sum(fr * power(0.98, -k)) OVER w * power(0.98, k) AS far FROM kk WINDOW w AS (PARTITION BY video_id, track_id, run ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
vv AS (SELECT *, CASE WHEN near > far * 1.5 THEN 'NEAR' WHEN far > near * 1.5 THEN 'FAR' ELSE 'UNKNOWN' END AS voted FROM vt)"""
_voted = lambda s, d: teams.team_votes(_team(s, d), ratio=1.5)
_add("stf4_team_vote", lambda s, d: rounded(_voted(s, d).select("video_id", "frame", "det_id", "near", "far", "voted")), f"WITH {_VOTE} SELECT video_id, frame, det_id, {R('near')} AS near, {R('far')} AS far, voted FROM vv")


#: Frames of a video that come out of order, two files of them: a micro-batch has no more of a video, however long it is.
STRETCH = 1 << 16


def _live_votes(s, d):
    """The detections as a stream of files whose frames come out of order, folded live; a last frame moves the watermark on."""
    rows = _team(s, d).where("track_id is not null").select("video_id", "frame", "det_id", "track_id", "team")
    end = s.range(1).select(F.lit(-1).cast("long").alias("video_id"), F.lit(1 << 30).cast("long").alias("frame"), F.lit(1).alias("det_id"), F.lit(1).cast("long").alias("track_id"), F.lit("NEAR").alias("team"))
    file = 2 * F.floor(F.col("frame") / STRETCH) + F.pmod(F.xxhash64("video_id", "frame"), F.lit(2))
    source = cut(rows.withColumn("file", file), "file")
    lateness = int(STRETCH * 1000 / FPS) + 1
    out = replayed([*source, end, end.withColumn("frame", F.col("frame") + 1)], lambda x: ordered.live_votes(x, ratio=1.5, lateness_ms=lateness))
    own = dict(rows.dtypes)
    return rounded(out.where("video_id >= 0").select(*(F.col(c).cast(own[c]).alias(c) for c in ("video_id", "frame", "det_id")), "near", "far", "voted", "late"))


_add("stf4_live_team_vote", _live_votes, f"WITH {_VOTE} SELECT video_id, frame, det_id, {R('near')} AS near, {R('far')} AS far, voted, false AS late FROM vv")
_add("win14_vote_decay", lambda s, d: rounded(teams.team_votes(_team(s, d)).select("video_id", "frame", "det_id", "near")), f"WITH {_VOTE} SELECT video_id, frame, det_id, {R('near')} AS near FROM vv")
_add("flt5_team_vote_filter", lambda s, d: teams.team_vote_filter(_voted(s, d), "NEAR", 0.0, 2).select("video_id", "frame", "det_id"), f"WITH {_VOTE}, q AS (SELECT video_id, frame, det_id, row_number() OVER (PARTITION BY video_id, frame ORDER BY y - 450 DESC, det_id) AS k FROM vv WHERE voted = 'NEAR' AND y - 450 >= 0) SELECT video_id, frame, det_id FROM q WHERE k <= 2")


def _preflight(s, d):
    det = X.detections(s, d)
    per = det.groupBy("video_id", "frame").agg(F.count(F.when(F.col("kind") == "person", 1)).alias("n_raw"), F.count(F.when((F.col("kind") == "person") & (F.col("conf") > 0.1), 1)).alias("n_mask"), F.count(F.when((F.col("kind") == "person") & (F.col("conf") > 0.4), 1)).alias("n_team"), F.max(F.when(F.col("kind") == "ball", 1).otherwise(0)).alias("ball"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    return per.groupBy("video_id").agg(half("n_raw").alias("raw_person_median"), half("n_mask").alias("masked_person_median"), half("n_team").alias("team_person_median"), F.avg("ball").alias("ball_recall"), F.count("*").alias("n_frames"))


_PRE = f"{DET}, pf AS (SELECT video_id, frame, count(CASE WHEN kind = 'person' THEN 1 END) AS n_raw, count(CASE WHEN kind = 'person' AND conf > 0.1 THEN 1 END) AS n_mask, count(CASE WHEN kind = 'person' AND conf > 0.4 THEN 1 END) AS n_team, max(CASE WHEN kind = 'ball' THEN 1 ELSE 0 END) AS ball FROM det GROUP BY 1, 2), ps AS (SELECT video_id, quantile_cont(n_raw, 0.5) AS raw_person_median, quantile_cont(n_mask, 0.5) AS masked_person_median, quantile_cont(n_team, 0.5) AS team_person_median, avg(ball) AS ball_recall, count(*) AS n_frames FROM pf GROUP BY 1)"
_PC = ("raw_person_median", "masked_person_median", "team_person_median", "ball_recall")
_add("agg22_preflight_stats", lambda s, d: rounded(_preflight(s, d)), f"WITH {_PRE} SELECT video_id, {_list(_PC)}, n_frames FROM ps")
_add("ana17_preflight_verdict", lambda s, d: teams.preflight_verdict(_preflight(s, d).drop("n_frames")).select("video_id", "level", "stage"), f"WITH {_PRE} SELECT video_id, 'FATAL' AS level, 'detection' AS stage FROM ps WHERE raw_person_median < 4 UNION ALL SELECT video_id, CASE WHEN team_person_median < 3 THEN 'FATAL' ELSE 'WARN' END, 'team split' FROM ps WHERE raw_person_median >= 4 AND masked_person_median > 0 AND (team_person_median < 3 OR team_person_median > 9 OR abs(team_person_median - 6) > 2) UNION ALL SELECT video_id, 'FATAL', 'court mask' FROM ps WHERE raw_person_median >= 4 AND masked_person_median <= 0 UNION ALL SELECT video_id, 'WARN', 'ball' FROM ps WHERE raw_person_median >= 4 AND masked_person_median > 0 AND ball_recall < 0.2")
_metrics = lambda s, d: frames.window_metrics(frame_channels(s, d))
_RANGES = (("mean_spacing_cm", 200.0, 350.0, "cm"), ("speed_top2_cm_frame", 5.0, 12.0, "cm"), ("centroid_vel_cm_per_frame", 1.0, 8.0, "cm"))
_add("ana9_literature_table", lambda s, d: rounded(teams.reference_table(_metrics(s, d), _RANGES).select("metric", "median", "n", "place")))
_add("ana8_tactical_deviation", lambda s, d: rounded(teams.tactical_deviation(_metrics(s, d).join(rules.label_clips(X.raw_positions(s, d)).select("match_id", "sequence", "label"), ["match_id", "sequence"]), ("sync_score", "mean_spacing_cm", "centroid_vel_cm_per_frame", "speed_top2_cm_frame")).select("match_id", "sequence", "label", "deviation"), digits=4))
