"""Queries of scalar functions: geometry, numbers, names, times and probability arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import geometry as G
from ..functions import scalars as S
from .base import PAIRS, POS, RAW, Query, R, frame_rows, positions, r, rounded

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DET = f"{RAW}, det AS ({X.detections_sql()}), per AS (SELECT * FROM det WHERE kind = 'person')"
_ID = ("video_id", "frame", "det_id")


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _people(s, d):
    return X.detections(s, d).where("kind = 'person'")


def _person_query(name: str, columns: Callable[[], dict], sql: dict[str, str]) -> None:
    """A query of one expression or more over person boxes, with its SQL."""
    _add(name, lambda s, d: rounded(_people(s, d).select(*_ID, *(c.alias(n) for n, c in columns().items()))), f"WITH {DET} SELECT video_id, frame, det_id, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + " FROM per")


_c = F.col
_foot = lambda: G.foot_point(_c("x1"), _c("y1"), _c("x2"), _c("y2"))
_person_query("geo1_foot_point", lambda: {"foot_x": _foot()["x"], "foot_y": _foot()["y"]}, {"foot_x": R("(x1 + x2) / 2"), "foot_y": R("y2")})
_add("geo2_pairwise_distance", lambda s, d: rounded(frame_rows(s, d).select("match_id", "sequence", "frame_id", F.explode(G.pair_distances(_c("players"))).alias("dist"))), f"WITH {PAIRS} SELECT match_id, sequence, frame_id, {R('d')} AS dist FROM pairs WHERE s1 < s2")
_add("geo3_hull_area", lambda s, d: rounded(frame_rows(s, d).select("match_id", "frame_id", G.hull_area(_c("players")).alias("area"))), f"WITH {PAIRS} SELECT match_id, frame_id, {R('hull_area')} AS area FROM descr")
_quad = lambda: F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((100.0, 80.0), (1000.0, 120.0), (980.0, 700.0), (60.0, 640.0))))
_add("geo4_quad_signed_distance", lambda s, d: rounded(_people(s, d).select(*_ID, G.quad_signed_distance(_foot()["x"], _foot()["y"], _quad()).alias("dist"))))
_h = lambda: F.array(0.5 + _c("video_id") / 100, F.lit(0.01), F.lit(3.0), F.lit(0.002), F.lit(0.6), F.lit(5.0), F.lit(0.00001), F.lit(0.00002), F.lit(1.0))
_p = lambda: G.apply_homography(_h(), _foot()["x"], _foot()["y"])
_w = "(0.00001 * (x1 + x2) / 2 + 0.00002 * y2 + 1.0)"
_person_query("geo5_homography_apply", lambda: {"court_x": _p()["x"], "court_y": _p()["y"]}, {"court_x": R(f"((0.5 + video_id / CAST(100 AS DOUBLE)) * (x1 + x2) / 2 + 0.01 * y2 + 3.0) / {_w}"), "court_y": R(f"(0.002 * (x1 + x2) / 2 + 0.6 * y2 + 5.0) / {_w}")})
_lin = lambda: G.linear_scale(_foot()["x"], _foot()["y"], F.lit(1280.0), F.lit(720.0))
_person_query("geo6_linear_scale", lambda: {"court_x": _lin()["x"], "court_y": _lin()["y"]}, {"court_x": R("(x1 + x2) / 2 / 1280 * 1800"), "court_y": R("y2 / 720 * 900")})
_box = lambda: F.array(*(F.struct(_c(a).alias("x"), _c(b).alias("y")) for a, b in (("x2", "y2"), ("x1", "y1"), ("x1", "y2"), ("x2", "y1"))))
_ordered = lambda: G.order_corners(_box())
_person_query("geo8_order_corners", lambda: {f"{n}_{a}": _ordered()[k][a] for k, n in enumerate(("tl", "tr", "br", "bl")) for a in "xy"}, {"tl_x": R("x1"), "tl_y": R("y1"), "tr_x": R("x2"), "tr_y": R("y1"), "br_x": R("x2"), "br_y": R("y2"), "bl_x": R("x1"), "bl_y": R("y2")})
_add("geo9_net_distance", lambda s, d: rounded(positions(s, d).select("match_id", "frame_id", "slot", G.net_distance(_c("y"), "bottom").alias("bottom"), G.net_distance(_c("y"), "top").alias("top"))), f"WITH {POS} SELECT match_id, frame_id, slot, {R('y - 450')} AS bottom, {R('450 - y')} AS top FROM pos")
_add("geo10_geometric_team", lambda s, d: positions(s, d).select("match_id", "frame_id", "slot", G.geometric_team(_c("y"), 120.0).alias("team")), f"WITH {POS} SELECT match_id, frame_id, slot, CASE WHEN y >= 570 THEN 'NEAR' WHEN y <= 330 THEN 'FAR' ELSE 'UNKNOWN' END AS team FROM pos")


def _iou(s, d):
    box = lambda p: F.struct(*(_c(f"{p}.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
    a, b = _people(s, d).alias("a"), _people(s, d).alias("b")
    both = a.join(b, (_c("a.video_id") == _c("b.video_id")) & (_c("a.frame") == _c("b.frame")) & (_c("a.det_id") < _c("b.det_id")))
    return rounded(both.select(_c("a.video_id").alias("video_id"), _c("a.frame").alias("frame"), _c("a.det_id").alias("a"), _c("b.det_id").alias("b"), G.box_iou(box("a"), box("b")).alias("iou")))


_iw, _ih = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))", "greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_add("geo11_iou", _iou, f"WITH {DET} SELECT a.video_id, a.frame, a.det_id AS a, b.det_id AS b, {R(f'{_iw} * {_ih} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_iw} * {_ih} + 1e-9)')} AS iou FROM per a JOIN per b ON a.video_id = b.video_id AND a.frame = b.frame AND a.det_id < b.det_id")
_moved = lambda: G.apply_affine(F.array(*(F.lit(v) for v in (0.9, -0.1, 4.0, 0.1, 0.9, -2.0))), _box())
_person_query("geo12_affine_apply", lambda: {"x0": _moved()[0]["x"], "y0": _moved()[0]["y"], "x3": _moved()[3]["x"], "y3": _moved()[3]["y"]}, {"x0": R("0.9 * x2 - 0.1 * y2 + 4.0"), "y0": R("0.1 * x2 + 0.9 * y2 - 2.0"), "x3": R("0.9 * x2 - 0.1 * y1 + 4.0"), "y3": R("0.1 * x2 + 0.9 * y1 - 2.0")})
_add("mth1_cosine", lambda s, d: rounded(_people(s, d).select(*_ID, S.cosine(_c("x1") + 1e-3, _c("y1"), _c("x2"), _c("y2")).alias("cos"))), f"WITH {DET} SELECT video_id, frame, det_id, {R('((x1 + 1e-3) * x2 + y1 * y2) / (sqrt((x1 + 1e-3) * (x1 + 1e-3) + y1 * y1) * sqrt(x2 * x2 + y2 * y2))')} AS cos FROM per")
_add("mth7_wrap_angle", lambda s, d: rounded(_people(s, d).select(*_ID, S.wrap_angle(F.atan2("y1", "x1") * 3).alias("angle"))), f"WITH {DET}, a AS (SELECT video_id, frame, det_id, atan2(y1, x1) * 3 AS t FROM per) SELECT video_id, frame, det_id, {R('t - 2 * pi() * floor((t + pi()) / (2 * pi()))')} AS angle FROM a")
_add("mth5_ratio_clip", lambda s, d: rounded(_people(s, d).select(*_ID, S.ratio_clip(_c("x1"), _c("y1") - 250).alias("ratio"))), f"WITH {DET} SELECT video_id, frame, det_id, {R('greatest(-50, least(50, x1 / (abs(y1 - 250) + 1e-6)))')} AS ratio FROM per")
_add("mth8_round_half_even", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_quantity").agg(F.count("*").alias("n")).select(_c("l_quantity").cast("double").alias("q"), F.bround(_c("l_quantity").cast("double") / 2).alias("half"), "n"), "SELECT CAST(l_quantity AS DOUBLE) AS q, round_even(CAST(l_quantity AS DOUBLE) / 2, 0) AS half, count(*) AS n FROM lineitem GROUP BY 1, 2")
_add("mth3_slope", lambda s, d: rounded(positions(s, d).groupBy("match_id", "sequence").agg(S.slope(_c("ball_x"), _c("frame_id")).alias("slope")), digits=5), f"WITH {POS} SELECT match_id, sequence, (round(CASE WHEN count(DISTINCT CASE WHEN ball_x IS NOT NULL THEN frame_id END) < 2 THEN 0 ELSE regr_slope(ball_x, frame_id) END, 5) + CAST(0 AS DOUBLE)) AS slope FROM pos GROUP BY 1, 2")
_add("mth4_quantile_linear", lambda s, d: rounded(positions(s, d).groupBy("match_id", "sequence").agg(S.quantile(_c("x"), 0.95).alias("q95"), S.quantile(_c("y"), 0.5).alias("median"))), f"WITH {POS} SELECT match_id, sequence, {R('quantile_cont(x, 0.95)')} AS q95, {R('quantile_cont(y, 0.5)')} AS median FROM pos GROUP BY 1, 2")
_add("mth9_linspace_int", lambda s, d: positions(s, d).groupBy("match_id").agg(F.max("frame_id").alias("last")).select("match_id", F.explode(S.linspace_int(12, _c("last") - 1)).alias("frame_id")), f"WITH {POS}, m AS (SELECT match_id, max(frame_id) - 1 AS last FROM pos GROUP BY 1), g AS (SELECT match_id, last, unnest(range(0, 12)) AS i FROM m) SELECT match_id, CAST(floor(i * last / CAST(11 AS DOUBLE)) AS BIGINT) AS frame_id FROM g")

# probability arrays from orders
_W = "SELECT o_orderkey, CAST(o_orderkey % 7 AS DOUBLE) AS w1, CAST(o_custkey % 5 AS DOUBLE) AS w2, CAST((o_orderkey * 3) % 11 AS DOUBLE) AS w3, CAST(1 AS DOUBLE) AS w4 FROM {orders}"
_PSQL = f"w AS ({_W.replace('{orders}', 'orders')}), p AS (SELECT o_orderkey, w1 / (w1 + w2 + w3 + w4) AS p1, w2 / (w1 + w2 + w3 + w4) AS p2, w3 / (w1 + w2 + w3 + w4) AS p3, w4 / (w1 + w2 + w3 + w4) AS p4 FROM w), pm AS (SELECT *, greatest(p1, p2, p3, p4) AS m FROM p)"


def probabilities(s, d):
    w = s.sql(_W, **X.tables(s, d, "orders"))
    total = _c("w1") + _c("w2") + _c("w3") + _c("w4")
    return w.select("o_orderkey", F.array(*(_c(f"w{k}") / total for k in range(1, 5))).alias("probs"))


_H = "-(" + " + ".join(f"CASE WHEN p{k} > 0 THEN p{k} * log2(p{k}) ELSE 0 END" for k in range(1, 5)) + ")"
_add("mth2_entropy", lambda s, d: rounded(probabilities(s, d).select("o_orderkey", S.entropy_bits(_c("probs")).alias("entropy_bits"), S.entropy_norm(_c("probs")).alias("entropy_norm"))), f"WITH {_PSQL} SELECT o_orderkey, {R(_H)} AS entropy_bits, {R(f'{_H} / 2')} AS entropy_norm FROM p")
_ARG = "CASE WHEN p1 = m THEN 0 WHEN p2 = m THEN 1 WHEN p3 = m THEN 2 ELSE 3 END"
_NAMES = lambda: F.array(*(F.lit(x) for x in "ABCD"))
_add("arr1_argmax", lambda s, d: rounded(probabilities(s, d).select("o_orderkey", S.argmax(_c("probs")).alias("best"), F.array_max("probs").alias("confidence"))), f"WITH {_PSQL} SELECT o_orderkey, {_ARG} AS best, {R('m')} AS confidence FROM pm")
_add("flt9_confidence_abstain", lambda s, d: probabilities(s, d).select("o_orderkey", S.confidence_label(_c("probs"), _NAMES()).alias("label")), f"WITH {_PSQL} SELECT o_orderkey, CASE WHEN m >= 0.5 THEN substr('ABCD', {_ARG} + 1, 1) ELSE 'Uncertain' END AS label FROM pm")
_add("flt10_anomaly_flag", lambda s, d: probabilities(s, d).select("o_orderkey", (F.array_max("probs") < 0.4).alias("anomaly")), f"WITH {_PSQL} SELECT o_orderkey, m < 0.4 AS anomaly FROM pm")
_add("map1_prob_map", lambda s, d: rounded(probabilities(s, d).withColumn("m", F.map_from_arrays(_NAMES(), "probs")).select("o_orderkey", *(_c("m")[k].alias(f"p_{k}") for k in "ABCD"))), f"WITH {_PSQL} SELECT o_orderkey, {R('p1')} AS \"p_A\", {R('p2')} AS \"p_B\", {R('p3')} AS \"p_C\", {R('p4')} AS \"p_D\" FROM p")
_add("agg21_confidence_profile", lambda s, d: rounded(probabilities(s, d).select(F.array_max("probs").alias("c"), S.entropy_bits(_c("probs")).alias("e")).agg(F.avg("c").alias("mean_confidence"), S.quantile(_c("c"), 0.5).alias("median_confidence"), F.avg((_c("c") > 0.6).cast("double")).alias("share_over"), F.avg("e").alias("mean_entropy"))), f"WITH {_PSQL} SELECT {R('avg(m)')} AS mean_confidence, {R('quantile_cont(m, 0.5)')} AS median_confidence, {R('avg(CASE WHEN m > 0.6 THEN 1.0 ELSE 0.0 END)')} AS share_over, {R(f'avg({_H})')} AS mean_entropy FROM pm")

# names and times from customers and orders
_NAME = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Delayed_Support__videoplayback_clip_' WHEN 1 THEN 'Coordinated_Attack__videoplayback (' || CAST(c_nationkey AS STRING) || ')_clip_' WHEN 2 THEN 'videoplayback  (' || CAST(c_custkey % 3 AS STRING) || ')_clip_' ELSE 'other_' END || CAST(c_custkey AS STRING) AS name FROM {customer}"
_names = lambda s, d: s.sql(_NAME, **X.tables(s, d, "customer"))
_NSQL = f"n AS ({_NAME.replace('{customer}', 'customer').replace('AS STRING', 'AS VARCHAR')})"
_add("scl1_video_key", lambda s, d: _names(s, d).select("c_custkey", S.video_key(_c("name")).alias("video_key")), f"WITH {_NSQL} SELECT c_custkey, CASE WHEN NOT regexp_matches(name, 'videoplayback(\\s*(\\(\\d+\\)))?_clip') THEN '?' WHEN regexp_extract(name, '\\(\\d+\\)') = '' THEN '(plain)' ELSE regexp_extract(name, '\\(\\d+\\)') END AS video_key FROM n")
_STEM = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Frame_' WHEN 1 THEN 'clip7-frame' WHEN 2 THEN 'img' ELSE 'none' END || CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE CAST(o_orderkey AS STRING) END AS stem FROM {orders}"
_stems = lambda s, d: s.sql(_STEM, **X.tables(s, d, "orders"))
_SSQL = f"f AS ({_STEM.replace('{orders}', 'orders').replace('AS STRING', 'AS VARCHAR')})"
_add("scl2_frame_number", lambda s, d: _stems(s, d).select("o_orderkey", S.frame_number(_c("stem")).alias("frame")), f"WITH {_SSQL} SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS frame FROM f")
_EVENT = """SELECT o_orderkey, 'match_' || CAST(o_custkey % 5 AS STRING) || '.mp4' AS video_file,
 CASE o_orderkey % 6 WHEN 0 THEN ' Coordinated Attack' WHEN 1 THEN 'coordinated_defence ' WHEN 2 THEN 'DELAYED support' WHEN 3 THEN 'Spacing_Breakdown' WHEN 4 THEN 'coordinated defense' ELSE 'timeout' END AS tactic_class,
 CASE WHEN o_orderkey % 10 = 9 THEN '12:34' ELSE lpad(CAST(o_custkey % 3 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') || ':' || lpad(CAST((o_orderkey * 7) % 60 AS STRING), 2, '0') || '.5' END AS anchor_time FROM {orders}"""
event_rows = lambda s, d: s.sql(_EVENT, **X.tables(s, d, "orders"))
_ESQL = f"e AS ({_EVENT.replace('{orders}', 'orders').replace('AS STRING', 'AS VARCHAR')})"
_TACTIC = "CASE o_orderkey % 6 WHEN 0 THEN 'Coordinated_Attack' WHEN 1 THEN 'Coordinated_Defense' WHEN 2 THEN 'Delayed_Support' WHEN 3 THEN 'Spacing_Breakdown' WHEN 4 THEN 'Coordinated_Defense' END"
_SECONDS = "CASE WHEN o_orderkey % 10 <> 9 THEN CAST(substr(anchor_time, 1, 2) AS DOUBLE) * 3600 + CAST(substr(anchor_time, 4, 2) AS DOUBLE) * 60 + CAST(substr(anchor_time, 7) AS DOUBLE) END"
ESQL = f"{_ESQL}, ev AS (SELECT o_orderkey, video_file, {_TACTIC} AS tactic, {_SECONDS} AS t FROM e)"
_add("scl3_tactic_canonical", lambda s, d: event_rows(s, d).select("o_orderkey", S.canonical_tactic(_c("tactic_class")).alias("tactic")), f"WITH {ESQL} SELECT o_orderkey, tactic FROM ev")
_add("scl4_hms_seconds", lambda s, d: rounded(event_rows(s, d).withColumn("t", S.hms_to_seconds(_c("anchor_time"))).select("o_orderkey", "t", S.seconds_to_hms(_c("t") - 600).alias("text"))), f"WITH {ESQL}, u AS (SELECT o_orderkey, t, greatest(t - 600, 0) AS s FROM ev) SELECT o_orderkey, {R('t')} AS t, CASE WHEN t IS NULL THEN NULL ELSE format('{{:02d}}:{{:02d}}:{{:06.3f}}', CAST(floor(s / 3600) AS INTEGER), CAST(floor((s % 3600) / 60) AS INTEGER), s % 60) END AS text FROM u")
_add("scl5_clip_name_build", lambda s, d: event_rows(s, d).select("o_orderkey", S.clip_name(_c("video_file"), _c("o_orderkey") % 1500).alias("clip"), S.annotation_name(_c("tactic_class"), _c("video_file")).alias("name")), f"WITH {ESQL}, b AS (SELECT *, CAST(o_orderkey % 1500 AS VARCHAR) AS k FROM e) SELECT o_orderkey, video_file || '_clip_' || CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE substr(k, 1, 3) END AS clip, tactic_class || '__' || video_file || '.csv' AS name FROM b")
_add("scl6_label_index", lambda s, d: event_rows(s, d).select("o_orderkey", S.label_index(F.initcap(F.trim(F.regexp_replace("tactic_class", "_", " ")))).alias("label_index")), f"WITH {ESQL} SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 2 ELSE 0 END AS label_index FROM e")
_add("scl9_holdout_key", lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", S.holdout_key(F.when(_c("n_nationkey") % 2 == 0, F.concat(F.lit("("), _c("n_nationkey").cast("string"), F.lit(")"))).otherwise(_c("n_nationkey").cast("string"))).alias("key")), "SELECT n_nationkey, '(' || CAST(n_nationkey AS VARCHAR) || ')' AS key FROM nation")


def _windows(s, d):
    e = event_rows(s, d).withColumn("tactic", S.canonical_tactic(_c("tactic_class"))).withColumn("t", S.hms_to_seconds(_c("anchor_time"))).where("tactic is not null and t is not null")
    return rounded(e.withColumn("w", S.event_window(_c("tactic"), _c("t"))).select("o_orderkey", "tactic", "w.start_s", "w.end_s"))


_add("scl10_event_window", _windows, f"WITH {ESQL} SELECT o_orderkey, tactic, {R('CASE WHEN tactic = $$Coordinated_Defense$$ THEN t - 0.5 ELSE t END')} AS start_s, {R('CASE WHEN tactic = $$Coordinated_Defense$$ THEN t + 0.5 ELSE t + 1 END')} AS end_s FROM ev WHERE tactic IS NOT NULL AND t IS NOT NULL")
