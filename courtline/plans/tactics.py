"""Queries of the tactical rules and their report."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import frames, rules
from .base import RAW, Query, R, rounded

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def outcome_rows(raw):
    """Raw positions of the last 12 frames of each whole window: its outcome."""
    return frames.whole_windows(raw).where((F.col("frame_id") - 1) % 29 >= 17)


def _rows(spark, sf_dir):
    return outcome_rows(X.raw_positions(spark, sf_dir))


_EV = f"{RAW}, full_w AS (SELECT match_id, sequence FROM raw GROUP BY 1, 2 HAVING count(DISTINCT frame_id) = 29), ev AS (SELECT r.*, (r.frame_id - 1) % 29 - 17 AS i FROM raw r JOIN full_w f ON f.match_id = r.match_id AND f.sequence = r.sequence WHERE (r.frame_id - 1) % 29 >= 17), occ AS (SELECT * FROM ev WHERE NOT (x = 0 AND y = 0))"
_NEAR = "nr AS (SELECT a.match_id, a.sequence, a.frame_id, a.slot, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS nn FROM occ a JOIN occ b ON a.match_id = b.match_id AND a.frame_id = b.frame_id AND a.slot <> b.slot GROUP BY 1, 2, 3, 4)"
_SPACING = f"{_NEAR}, r1 AS (SELECT f.match_id, f.sequence, coalesce(bool_or(nn > 600 OR nn < 50), false) AS spacing FROM full_w f LEFT JOIN nr ON nr.match_id = f.match_id AND nr.sequence = f.sequence GROUP BY 1, 2)"
_STEP = "st AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM ev WINDOW w AS (PARTITION BY match_id, sequence, slot ORDER BY frame_id))"
_BALL = """bl AS (SELECT match_id, sequence, i, max(ball_x) AS ball_x, max(ball_y) AS ball_y FROM ev GROUP BY 1, 2, 3),
b1 AS (SELECT *, ball_x - lag(ball_x) OVER w AS dx, ball_y - lag(ball_y) OVER w AS dy FROM bl WINDOW w AS (PARTITION BY match_id, sequence ORDER BY i)),
b2 AS (SELECT *, lag(dy) OVER w AS dy0, sqrt(dx * dx + dy * dy) AS sp, lag(sqrt(dx * dx + dy * dy)) OVER w AS sp0 FROM b1 WINDOW w AS (PARTITION BY match_id, sequence ORDER BY i)),
imp AS (SELECT match_id, sequence, CASE WHEN bool_or(NOT (ball_x = 0 AND ball_y = 0)) THEN coalesce(min(CASE WHEN dy0 * dy <= 0 THEN i - 1 END), min(CASE WHEN sp0 > 5 AND sp < sp0 * 0.4 THEN i - 1 END)) END AS impact FROM b2 GROUP BY 1, 2)"""
_CLOSE = "cl AS (SELECT match_id, sequence, impact, slot AS closest FROM (SELECT e.*, impact, row_number() OVER (PARTITION BY e.match_id, e.sequence ORDER BY sqrt((x - ball_x) * (x - ball_x) + (y - ball_y) * (y - ball_y)), slot) AS rk FROM ev e JOIN imp ON imp.match_id = e.match_id AND imp.sequence = e.sequence AND e.i = impact) q WHERE rk = 1)"
_PEAK = "pk AS (SELECT match_id, sequence, slot, i - 1 AS peak FROM (SELECT *, row_number() OVER (PARTITION BY match_id, sequence, slot ORDER BY step DESC, i) AS rk FROM st WHERE step IS NOT NULL) q WHERE rk = 1)"
_DELAYED = "r2 AS (SELECT f.match_id, f.sequence, coalesce(peak - impact > 5, false) AS delayed FROM full_w f LEFT JOIN cl ON cl.match_id = f.match_id AND cl.sequence = f.sequence LEFT JOIN pk ON pk.match_id = f.match_id AND pk.sequence = f.sequence AND pk.slot = closest)"
_ATTACK = """sp AS (SELECT match_id, sequence, slot, avg(step) * 30 AS v FROM st GROUP BY 1, 2, 3),
sr AS (SELECT *, row_number() OVER (PARTITION BY match_id, sequence ORDER BY v DESC, slot) AS rk FROM sp),
r3 AS (SELECT sr.match_id, sr.sequence, avg(CASE WHEN rk <= 2 THEN v END) > 300 AND avg(CASE WHEN rk > 2 THEN v END) < 150 AND max(CASE WHEN b.ok THEN 1 ELSE 0 END) = 1 AS attack
  FROM sr JOIN (SELECT match_id, sequence, bool_or(NOT (ball_x = 0 AND ball_y = 0)) AND bool_or(ball_y < 500) AS ok FROM ev GROUP BY 1, 2) b ON b.match_id = sr.match_id AND b.sequence = sr.sequence GROUP BY 1, 2)"""
_DEFENSE = """cf AS (SELECT e.match_id, e.sequence, e.frame_id, coalesce(avg(CASE WHEN NOT (x = 0 AND y = 0) THEN x END), avg(x)) AS cx, coalesce(avg(CASE WHEN NOT (x = 0 AND y = 0) THEN y END), avg(y)) AS cy FROM ev e GROUP BY 1, 2, 3),
sv AS (SELECT c.match_id, c.sequence, c.frame_id, coalesce(avg((o.x - cx) * (o.x - cx) + (o.y - cy) * (o.y - cy)), 0) AS sv, max(cx) AS cx, max(cy) AS cy FROM cf c LEFT JOIN occ o ON o.match_id = c.match_id AND o.frame_id = c.frame_id GROUP BY 1, 2, 3),
cm AS (SELECT *, sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) AS mv FROM sv WINDOW w AS (PARTITION BY match_id, sequence ORDER BY frame_id)),
r4 AS (SELECT match_id, sequence, coalesce(avg(mv) > 3 AND avg(sv) <> 0 AND stddev_pop(sv) < 0.3 * avg(sv), false) AS defense FROM cm GROUP BY 1, 2)"""
_ALL = f"{_EV}, {_SPACING}, {_STEP}, {_BALL}, {_CLOSE}, {_PEAK}, {_DELAYED}, {_ATTACK}, {_DEFENSE}, lab AS (SELECT r1.match_id, r1.sequence, attack, defense, delayed, spacing, CASE WHEN attack THEN 'Coordinated Attack' WHEN defense THEN 'Coordinated Defense' WHEN delayed THEN 'Delayed Support' WHEN spacing THEN 'Spacing Breakdown' ELSE 'Unclassified' END AS label FROM r1 JOIN r2 ON r2.match_id = r1.match_id AND r2.sequence = r1.sequence JOIN r3 ON r3.match_id = r1.match_id AND r3.sequence = r1.sequence JOIN r4 ON r4.match_id = r1.match_id AND r4.sequence = r1.sequence)"

_add("ana4_rule_spacing", lambda s, d: rules.spacing_rule(_rows(s, d)), f"WITH {_EV}, {_SPACING} SELECT * FROM r1")
_add("win4_impact_frame", lambda s, d: rules.impact_frames(rules.ball_frames(_rows(s, d))).withColumn("impact", F.col("impact").cast("long")), f"WITH {_EV}, {_BALL} SELECT match_id, sequence, CAST(impact AS BIGINT) AS impact FROM imp")
_add("win5_nearest_at_impact", lambda s, d: rules.nearest_at_impact(_rows(s, d)).withColumn("impact", F.col("impact").cast("long")), f"WITH {_EV}, {_BALL}, {_CLOSE} SELECT match_id, sequence, CAST(impact AS BIGINT) AS impact, closest FROM cl")
_add("win6_peak_speed_frame", lambda s, d: rules.peak_frames(_rows(s, d)).withColumn("peak", F.col("peak").cast("long")), f"WITH {_EV}, {_STEP}, {_PEAK} SELECT match_id, sequence, slot, CAST(peak AS BIGINT) AS peak FROM pk")
_add("ana3_rule_delayed", lambda s, d: rules.delayed_rule(_rows(s, d)), f"WITH {_EV}, {_STEP}, {_BALL}, {_CLOSE}, {_PEAK}, {_DELAYED} SELECT * FROM r2")
_add("ana1_rule_attack", lambda s, d: rules.attack_rule(_rows(s, d)), f"WITH {_EV}, {_STEP}, {_ATTACK} SELECT * FROM r3")
_add("ana2_rule_defense", lambda s, d: rules.defense_rule(_rows(s, d)), f"WITH {_EV}, {_DEFENSE} SELECT * FROM r4")
_add("ana5_label_clip", lambda s, d: rules.label_clips(_rows(s, d)), f"WITH {_ALL} SELECT * FROM lab")
_REPORT = """every AS (SELECT * FROM (VALUES (0, 'Unclassified'), (1, 'Coordinated Attack'), (2, 'Coordinated Defense'), (3, 'Delayed Support'), (4, 'Spacing Breakdown')) v(label_index, label)),
ct AS (SELECT e.label_index, e.label, count(l.label) AS n FROM every e LEFT JOIN lab l ON l.label = e.label GROUP BY 1, 2),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN label_index > 0 THEN n ELSE 0 END) AS BIGINT) AS tactical, sum(CASE WHEN label_index IN (1, 2) THEN n ELSE 0 END) AS good FROM ct),
pc AS (SELECT ct.*, total, tactical, CASE WHEN total > 0 THEN round_even(n / CAST(total AS DOUBLE) * 100, 1) ELSE 0 END AS percent, CASE WHEN tactical > 0 THEN round_even(good / CAST(tactical AS DOUBLE) * 100, 1) ELSE 0 END AS efficiency FROM ct, tot)"""
_add("agg10_label_report", lambda s, d: rules.label_report(rules.label_clips(_rows(s, d))), f"WITH {_ALL}, {_REPORT} SELECT label_index, label, n, percent, total, tactical, efficiency, (SELECT label FROM ct ORDER BY n DESC, label_index LIMIT 1) AS dominant, CASE WHEN efficiency >= 60 THEN 'strong' WHEN efficiency >= 40 THEN 'moderate' ELSE 'weak' END AS band, repeat('█', CAST(floor(percent / 5) AS INTEGER)) || repeat('░', 20 - CAST(floor(percent / 5) AS INTEGER)) AS bar FROM pc")
_add("agg12_class_distribution", lambda s, d: rules.label_clips(_rows(s, d)).rollup("match_id", "label").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")), f"WITH {_ALL} SELECT match_id, label, count(*) AS n, CAST(grouping(match_id, label) AS INTEGER) AS level FROM lab GROUP BY ROLLUP (match_id, label)")


def _class_means(s, d):
    k = ["match_id", "sequence"]
    gate = frames.activity_gate(frames.slot_velocity(X.raw_positions(s, d)))
    return rules.label_clips(_rows(s, d)).join(gate, k).groupBy("label").agg(F.avg("gate_mean_speed_cm_frame").alias("mean_speed"), F.avg("gate_players_present").alias("mean_players"), F.count("*").alias("n_clips"))


_add("agg11_per_class_means", lambda s, d: rounded(_class_means(s, d)), f"WITH {_ALL}, vv AS (SELECT match_id, sequence, frame_id, slot, x, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS sp FROM raw WINDOW w AS (PARTITION BY match_id, sequence, slot ORDER BY frame_id)), g AS (SELECT match_id, sequence, avg(sp) AS ms, count(x) / CAST(count(DISTINCT frame_id) AS DOUBLE) AS np FROM vv GROUP BY 1, 2) SELECT label, {R('avg(ms)')} AS mean_speed, {R('avg(np)')} AS mean_players, count(*) AS n_clips FROM lab JOIN g ON g.match_id = lab.match_id AND g.sequence = lab.sequence GROUP BY 1")
