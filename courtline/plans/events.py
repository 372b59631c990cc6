"""Queries of events, intervals, ordered splits and density grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..constants import TACTICS
from ..operators import events as E
from ..operators import scores
from .base import POS, RAW, Query, R, positions, rounded
from .geometry import ESQL, event_rows

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_INT = f"{ESQL}, iv AS (SELECT o_orderkey, video_file, tactic, t, greatest(0, CASE WHEN tactic = 'Coordinated_Defense' THEN t - 0.5 ELSE t END) AS start_s, CASE WHEN tactic = 'Coordinated_Defense' THEN t + 0.5 ELSE t + 1 END AS end_s FROM ev WHERE tactic IS NOT NULL AND t IS NOT NULL)"
_add("src3_event_label_scan", lambda s, d: E.event_labels(event_rows(s, d))[0].groupBy("video_file", "tactic").agg(F.count("*").alias("n"), F.min("t").alias("first_t")).unionByName(E.event_labels(event_rows(s, d))[1].groupBy("video_file", F.col("reason").alias("tactic")).agg(F.count("*").alias("n"), F.min("t").alias("first_t"))), f"WITH {ESQL} SELECT video_file, coalesce(CASE WHEN t IS NULL AND tactic IS NOT NULL THEN 'bad time' ELSE tactic END, 'unknown tactic') AS tactic, count(*) AS n, min(t) AS first_t FROM ev GROUP BY 1, 2")


def _frame_points(s, d):
    f = X.raw_positions(s, d).select("match_id", "frame_id").distinct()
    return f.select(F.concat(F.lit("match_"), (F.col("match_id") % 5).cast("string"), F.lit(".mp4")).alias("video_file"), "match_id", "frame_id", (F.col("frame_id") * 7.5).alias("t_s"))


_JOIN = f"{_INT}, {RAW}, fp AS (SELECT DISTINCT 'match_' || CAST(match_id % 5 AS VARCHAR) || '.mp4' AS video_file, match_id, frame_id, frame_id * 7.5 AS t_s FROM raw)"
_add("jn3_event_interval_join", lambda s, d: E.interval_join(_frame_points(s, d), E.event_labels(event_rows(s, d))[0].select("video_file", "o_orderkey", "tactic", "start_s", "end_s"), "video_file").select("match_id", "frame_id", "o_orderkey", "tactic"), f"WITH {_JOIN} SELECT match_id, frame_id, o_orderkey, tactic FROM fp JOIN iv ON iv.video_file = fp.video_file AND t_s BETWEEN start_s AND end_s")


def _truth(s, d):
    hit = E.interval_join(_frame_points(s, d), E.event_labels(event_rows(s, d))[0].select("video_file", "o_orderkey", "tactic", "start_s", "end_s"), "video_file")
    names = F.array(*(F.lit(t) for t in TACTICS))
    return scores.confusion_matrix(hit.select(F.regexp_replace("tactic", "_", " ").alias("y_true"), F.get(names, (F.col("frame_id") % 4).cast("int")).alias("y_pred")))


_cm = ", ".join(f"count(CASE WHEN frame_id % 4 = {k} THEN 1 END) AS {c.lower().replace(' ', '_')}" for k, c in enumerate(TACTICS))
_own = "CASE tactic " + " ".join(f"WHEN '{c.replace(' ', '_')}' THEN {k}" for k, c in enumerate(TACTICS)) + " END"
_add("ana19_truth_vs_prediction", lambda s, d: rounded(_truth(s, d)), f"WITH {_JOIN}, h AS (SELECT match_id, frame_id, tactic FROM fp JOIN iv ON iv.video_file = fp.video_file AND t_s BETWEEN start_s AND end_s), ev2 AS (SELECT * FROM (VALUES ('Coordinated_Attack'), ('Coordinated_Defense'), ('Delayed_Support'), ('Spacing_Breakdown')) v(name)) SELECT replace(name, '_', ' ') AS y_true, {_cm}, count(tactic) AS support, {R(f'CASE WHEN count(tactic) > 0 THEN count(CASE WHEN frame_id % 4 = {_own} THEN 1 END) / CAST(count(tactic) AS DOUBLE) ELSE 0 END')} AS recall FROM ev2 LEFT JOIN h ON h.tactic = name GROUP BY 1")
_add("top7_event_sort", lambda s, d: rounded(E.event_order(E.event_labels(event_rows(s, d))[0], "video_file", 1.0).select("video_file", "o_orderkey", "start_s", "end_s", "place", "seconds")), f"WITH {_INT}, q AS (SELECT video_file, o_orderkey, greatest(0, start_s - 1) AS start_s, end_s + 1 AS end_s FROM iv) SELECT video_file, o_orderkey, {R('start_s')} AS start_s, {R('end_s')} AS end_s, row_number() OVER w AS place, {R('sum(end_s - start_s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS seconds FROM q WINDOW w AS (PARTITION BY video_file ORDER BY start_s, end_s, o_orderkey)")
_frames = lambda s, d: X.raw_positions(s, d).select("match_id", "frame_id").distinct()
_BL = f"{RAW}, f AS (SELECT DISTINCT match_id, frame_id FROM raw), p AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame_id) - 1 AS pos, count(*) OVER (PARTITION BY match_id) AS n FROM f), b AS (SELECT match_id, frame_id, pos, CAST(" + " + ".join(f"CASE WHEN pos >= round_even({i} * n / CAST(12 AS DOUBLE), 0) THEN 1 ELSE 0 END" for i in range(1, 12)) + " AS INTEGER) AS block FROM p)"
_add("win12_temporal_block", lambda s, d: E.temporal_blocks(_frames(s, d), ("match_id",)).select("match_id", "frame_id", "block"), f"WITH {_BL} SELECT match_id, frame_id, block FROM b")
_VAL = ", ".join(map(str, E.spread_blocks()))
_SPLIT = f"{_BL}, v AS (SELECT *, CASE WHEN block IN ({_VAL}) THEN 1 ELSE 0 END AS is_val FROM b), sp AS (SELECT match_id, frame_id, CASE WHEN is_val = 1 THEN 'val' WHEN max(is_val) OVER (PARTITION BY match_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 THEN 'gap' ELSE 'train' END AS split FROM v)"
_split = lambda s, d: E.temporal_split(_frames(s, d), ("match_id",))
_add("win13_gap_quarantine", lambda s, d: _split(s, d).where("split = 'gap'").select("match_id", "frame_id"), f"WITH {_SPLIT} SELECT match_id, frame_id FROM sp WHERE split = 'gap'")
_add("ana21_temporal_split", lambda s, d: _split(s, d).select("match_id", "frame_id", "split"), f"WITH {_SPLIT} SELECT match_id, frame_id, split FROM sp")
_add("set2_split_partition", lambda s, d: _frames(s, d).exceptAll(_split(s, d).where("split <> 'train'").select("match_id", "frame_id")), f"WITH {_SPLIT} SELECT match_id, frame_id FROM sp WHERE split = 'train'")
_add("set5_split_revert", lambda s, d: _split(s, d).where("split = 'val'").unionByName(_split(s, d).where("split <> 'val'")).select("match_id", "frame_id", F.lit("train").alias("split")), f"WITH {_BL} SELECT match_id, frame_id, 'train' AS split FROM b")
_points = lambda s, d: positions(s, d).where("x is not null").select("match_id", "x", "y")
_add("set1_pool_points", lambda s, d: _points(s, d).select("x", "y").unionByName(positions(s, d).where("slot = 1 and ball_x is not null").select(F.col("ball_x").alias("x"), F.col("ball_y").alias("y"))).groupBy(F.floor(F.col("x") / 100).alias("col")).agg(F.count("*").alias("n")), f"WITH {POS}, u AS (SELECT x FROM pres UNION ALL SELECT ball_x FROM pos WHERE slot = 1 AND ball_x IS NOT NULL) SELECT CAST(floor(x / 100) AS BIGINT) AS col, count(*) AS n FROM u GROUP BY 1")
_GRID = f"{POS}, ct AS (SELECT CAST(least(floor((x + 40) / (CAST(1880 AS DOUBLE) / 72)), 71) AS INTEGER) AS bx, CAST(least(floor((y + 40) / (CAST(980 AS DOUBLE) / 36)), 35) AS INTEGER) AS b2, count(*) AS n FROM pres WHERE x BETWEEN -40 AND 1840 AND y BETWEEN -40 AND 940 GROUP BY 1, 2), gr AS (SELECT CAST(a.i AS INTEGER) AS bx, CAST(b.i AS INTEGER) AS b2 FROM (SELECT unnest(range(0, 72)) AS i) a CROSS JOIN (SELECT unnest(range(0, 36)) AS i) b), dg AS (SELECT gr.bx, gr.b2, coalesce(n, 0) AS n FROM gr LEFT JOIN ct ON ct.bx = gr.bx AND ct.b2 = gr.b2)"
_places = lambda s, d: positions(s, d).select("match_id", "x", "y")  # noqa: E731 - missing ones are in no cell
_add("agg25_density_grid", lambda s, d: E.density_grid(_places(s, d)), f"WITH {_GRID} SELECT bx, b2, n FROM dg")
_TAPS = "tp AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in zip(range(-5, 6), E.kernel_weights(), strict=True)) + ") v(k, w))"
_refl = lambda c, n: f"CASE WHEN {c} + k < 0 THEN -({c} + k) - 1 WHEN {c} + k >= {n} THEN {2 * n - 1} - ({c} + k) ELSE {c} + k END"
_SM = f"{_GRID}, {_TAPS}, s1 AS (SELECT o.bx, o.b2, sum(g.n * w) AS v FROM gr o CROSS JOIN tp JOIN dg g ON g.b2 = o.b2 AND g.bx = {_refl('o.bx', 72)} GROUP BY 1, 2), s2 AS (SELECT o.bx, o.b2, sum(g.v * w) AS v FROM gr o CROSS JOIN tp JOIN s1 g ON g.bx = o.bx AND g.b2 = {_refl('o.b2', 36)} GROUP BY 1, 2), s3 AS (SELECT bx, b2, v / (SELECT max(v) FROM s2) AS density FROM s2)"
_add("agg26_density_smooth", lambda s, d: rounded(E.density_smooth(E.cell_counts(_places(s, d)))), f"WITH {_SM} SELECT bx, b2, {R('density')} AS density FROM s3 WHERE density >= 0.03")


def _heatmap(s, d):
    layered = _places(s, d).withColumn("layer", F.when(F.col("y") >= 600, "near").otherwise("far"))
    return rounded(E.density_smooth(E.cell_counts(layered, ("layer",)), ("layer",), 0.05))


_add("ana24_position_heatmap", _heatmap, " UNION ALL ".join(f"SELECT bx, b2, {R('density')} AS density, '{n}' AS layer FROM (WITH {_SM.replace('FROM pres WHERE', f'FROM pres WHERE {c} AND')} SELECT * FROM s3) q WHERE density >= 0.05" for n, c in (("near", "y >= 600"), ("far", "y < 600"))))
