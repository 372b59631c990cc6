"""Queries of neighbours, thinning, calibration, label lines and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import frames, learning, neighbours, rules, scores, thinning
from ..operators.stored import stored
from ..sources import files
from .base import BOTH, POS, Query, R, frame_channels, moves, positions, rounded
from .formation import _LONG, _METRICS, _channels
from .geometry import DET

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_emb = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet")
_D2 = "list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_KNN = f"q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0), dd AS (SELECT query_id, vec_id, label, {_D2.format(a='qe', b='embedding')} AS d2 FROM q JOIN embeddings e ON e.vec_id <> query_id), nb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank FROM dd)"
_near = lambda s, d: neighbours.knn(_emb(s, d).where("vec_id % 20 = 0"), _emb(s, d))
_add("jn14_knn_join", lambda s, d: rounded(_near(s, d).withColumn("rank", F.col("rank").cast("long"))), f"WITH {_KNN} SELECT query_id, vec_id, label, {R('d2')} AS d2, rank FROM nb WHERE rank <= 5")
_add("jn14_knn_vote", lambda s, d: neighbours.knn_vote(_near(s, d)), f"WITH {_KNN}, vo AS (SELECT query_id, label, sum(1 / greatest(sqrt(d2), 1e-12)) AS w FROM nb WHERE rank <= 5 GROUP BY 1, 2), rv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, label) AS k FROM vo) SELECT query_id, label FROM rv WHERE k = 1")
_add("jn5_cluster_nearest", lambda s, d: rounded(neighbours.nearest_centre(_emb(s, d), learning.label_centres(_emb(s, d)))), f"WITH u AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings), c0 AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM u GROUP BY 1, 2), c AS (SELECT label AS team, list(m ORDER BY i) AS centre FROM c0 GROUP BY 1), d AS (SELECT vec_id, team, {_D2.format(a='embedding', b='centre')} AS d2 FROM embeddings CROSS JOIN c), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, team) AS r FROM d) SELECT vec_id, team, {R('d2')} AS d2 FROM k WHERE r = 1")
_THIN = """WITH RECURSIVE n AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
t AS (SELECT label, vec_id, k, e AS last, true AS keep FROM n WHERE k = 1
  UNION ALL SELECT label, vec_id, k, CASE WHEN far THEN e ELSE last END, far FROM (SELECT n.label, n.vec_id, n.k, n.e, t.last, list_avg(list_transform(list_zip(n.e, t.last), lambda z: abs(z[1] - z[2]))) >= 0.15 AS far FROM t JOIN n ON n.label = t.label AND n.k = t.k + 1))
SELECT label, vec_id FROM t WHERE keep"""
_add("top8_diverse_thin", lambda s, d: thinning.diverse_thin(_emb(s, d), "label", "vec_id", "embedding", 0.15), _THIN)
_frames = lambda s, d: positions(s, d).groupBy(F.col("match_id").alias("video_id"), F.col("frame_id").alias("frame")).agg(F.max("ball_x").alias("scale"))
_add("jn4_calibration_asof", lambda s, d: rounded(learning.calibration_asof(_frames(s, d), _frames(s, d).where("frame % 7 = 3"), ["scale"])), f"WITH {POS}, fr AS (SELECT match_id AS video_id, frame_id AS frame, max(ball_x) AS scale FROM pos GROUP BY 1, 2), k AS (SELECT f.video_id, f.frame, max(c.frame) AS at FROM fr f LEFT JOIN fr c ON c.video_id = f.video_id AND c.frame <= f.frame AND c.frame % 7 = 3 AND c.scale IS NOT NULL GROUP BY 1, 2) SELECT k.video_id, k.frame, {R('scale')} AS scale FROM k LEFT JOIN fr ON fr.video_id = k.video_id AND fr.frame = k.at")


def _frame_windows(s, d):
    w = frames.activity_gate(moves(s, d)).select("match_id", "sequence", "dead_ball")
    return positions(s, d).select("match_id", "sequence", "frame_id").distinct().join(w, ["match_id", "sequence"])


_add("jn6_frame_window_join", _frame_windows, f"WITH {POS}, v AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS sp FROM pos WINDOW w AS (PARTITION BY match_id, sequence, slot ORDER BY frame_id)), g AS (SELECT match_id, sequence, coalesce(avg(sp), 0) < 2.0 OR count(x) / CAST(count(DISTINCT frame_id) AS DOUBLE) < 3.0 AS dead_ball FROM v GROUP BY 1, 2) SELECT b.match_id, b.sequence, b.frame_id, dead_ball FROM base b JOIN g ON g.match_id = b.match_id AND g.sequence = b.sequence")
_add("agg19_norm_stats", lambda s, d: rounded(scores.norm_stats(_channels(s, d)), digits=4), f"WITH {BOTH}, {_LONG} SELECT channel, (round(avg(v), 4) + CAST(0 AS DOUBLE)) AS mean, (round(greatest(stddev_samp(v), 1e-6), 4) + CAST(0 AS DOUBLE)) AS std FROM chan GROUP BY 1")
_LINE = """SELECT CASE WHEN video_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, CAST(video_id AS STRING) || '_' || CAST(frame AS STRING) AS stem, frame, det_id,
  CASE WHEN det_id % 5 = 4 THEN '0 0.1 0.2' WHEN det_id % 5 = 3 THEN '1 0.1 0.2 0.3 0.4 0.5 1.7' WHEN det_id % 5 = 2 THEN '0 0.1 0.2 0.3 0.4 0.5 0.6' ELSE CAST(det_id % 2 AS STRING) || ' 0.5 0.5 0.25 0.125' END AS value FROM {det}"""
_lines = lambda s, d: s.sql(_LINE, det=X.detections(s, d).where("kind = 'person'"))
_LSQL = f"{DET}, ln AS ({_LINE.replace('{det}', 'per').replace('AS STRING', 'AS VARCHAR')}), pl2 AS (SELECT *, CASE WHEN det_id % 5 IN (3, 4) THEN 'bad' WHEN det_id % 5 = 2 THEN 'polygon' ELSE 'box' END AS kind, CAST(substr(value, 1, 1) AS INTEGER) AS class FROM ln)"
_add("scl8_label_line_parse", lambda s, d: files.parse_label_lines(_lines(s, d)).select("split", "stem", "det_id", "class", "kind"), f"WITH {_LSQL} SELECT split, stem, det_id, class, kind FROM pl2")
_add("agg28_label_file_audit", lambda s, d: files.label_file_audit(files.parse_label_lines(_lines(s, d))), f"WITH {_LSQL} SELECT split, count(CASE WHEN kind = 'box' THEN 1 END) AS n_box, count(CASE WHEN kind = 'polygon' THEN 1 END) AS n_polygon, count(CASE WHEN kind = 'bad' THEN 1 END) AS n_bad, count(DISTINCT stem) AS n_files, count(CASE WHEN class = 0 AND kind <> 'bad' THEN 1 END) AS n_class0 FROM pl2 GROUP BY 1")
_add("jn10_image_label_pairing", lambda s, d: files.image_label_pairing(_lines(s, d).where("frame % 5 <> 0"), _lines(s, d).where("frame % 7 <> 0")), f"WITH {_LSQL} SELECT DISTINCT split, stem, CASE WHEN frame % 7 = 0 THEN 'no label' ELSE 'no image' END AS problem FROM pl2 WHERE (frame % 5 <> 0 AND frame % 7 = 0) OR (frame % 5 = 0 AND frame % 7 <> 0)")
_add("set3_orphan_labels", lambda s, d: _lines(s, d).where("frame % 7 <> 0").select("split", "stem").subtract(_lines(s, d).where("frame % 5 <> 0").select("split", "stem")), f"WITH {_LSQL} SELECT DISTINCT split, stem FROM pl2 WHERE frame % 5 = 0 AND frame % 7 <> 0")


def _clips(s, d):
    """Metrics and label of each clip; both read one exchange of rows dealt by clip."""
    m = frames.window_metrics(frame_channels(s, d))
    lab = rules.label_clips(X.raw_positions(s, d, True)).select("match_id", "sequence", "label")
    clip = F.concat_ws("_", F.col("match_id").cast("string"), F.col("sequence").cast("string"))
    return stored(m.join(lab, ["match_id", "sequence"]).withColumn("clip", clip).withColumn("video", F.col("match_id")), "clips")


_OUT = ("y_true", "y_pred")
_folds = lambda s, d, model: learning.grouped_predictions(scores.kfold(_clips(s, d)), _METRICS, "fold", model)
for _model, _end in (("tree", ""), ("logistic", "_logistic"), ("forest", "_forest")):
    _add(f"ml5_lovo_predict{_end}", lambda s, d, m=_model: learning.grouped_predictions(_clips(s, d), _METRICS, "video", m).select("clip", "video", *_OUT))
    _add(f"ml4_kfold_predict{_end}", lambda s, d, m=_model: _folds(s, d, m).select("clip", "fold", *_OUT))
_add("ml4_kfold_report", lambda s, d: scores.classification_scores(_folds(s, d, "tree")))
for _model in ("gbt", "mlp", "knn"):
    _add(f"ml2_kfold_{_model}", lambda s, d, m=_model: rounded(_folds(s, d, m).select("clip", "fold", *_OUT, F.array_max("probs").alias("confidence"))))
