"""Queries of projection, model sequences and window verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import court
from .base import POS, RAW, Query, R, positions, rounded
from .tactics import ORACLE_SQL as _TACTICS

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _calibrations(s, d):
    """One quad per match, its size growing with the match's number."""
    v = X.raw_positions(s, d).select(F.col("match_id").alias("video_id")).distinct()
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n = F.col("video_id")
    corners = F.array(point(F.lit(900) + n, F.lit(420)), point(F.lit(100) - n, F.lit(200)), point(F.lit(60), F.lit(430) + n), point(F.lit(880), F.lit(210)))
    return v.select("video_id", corners.alias("corners"), (n % 2 == 0).alias("half"), F.lit(1280.0).alias("frame_w"), F.lit(720.0).alias("frame_h"))


def _people(s, d):
    return X.detections(s, d).where("kind = 'person'")


def _chain(s, d):
    f = X.raw_positions(s, d).select(F.col("match_id").alias("video_id"), F.col("frame_id").alias("frame")).distinct()
    number = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    return f.withColumn("corners", F.when(F.col("frame") % 50 == 3, number(0, 0, 10, 0, 10, 5, 0, 5))).withColumn("affine", F.when(F.col("frame") % 3 > 0, number(1, 0, 0.5, 0, 1, -0.25)))


QUERIES["geo7_homography_fit"] = lambda s, d: rounded(court.homography_fit(_calibrations(s, d)).select("video_id", "half", F.posexplode("h").alias("i", "h")))
QUERIES["flt3_court_mask"] = lambda s, d: court.court_mask(_people(s, d), _calibrations(s, d)).select("video_id", "frame", "det_id")
QUERIES["prj4_positions_from_tracks"] = lambda s, d: rounded(court.positions_from_tracks(_people(s, d), court.homography_fit(_calibrations(s, d))))
_CORNERS = ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3")
QUERIES["stf7_camera_chain"] = lambda s, d: rounded(court.camera_chain(_chain(s, d)).select("video_id", "frame", *(F.get("corners", F.lit(k)).alias(c) for k, c in enumerate(_CORNERS))))
ORACLE_SQL["stf7_camera_chain"] = f"""WITH RECURSIVE {RAW}, fr AS (SELECT DISTINCT match_id AS video_id, frame_id AS frame FROM raw),
st AS (SELECT video_id, frame, CASE WHEN frame % 50 = 3 THEN CAST([0, 0, 10, 0, 10, 5, 0, 5] AS DOUBLE[]) END AS c FROM fr WHERE frame = 1
  UNION ALL SELECT f.video_id, f.frame, CASE WHEN f.frame % 50 = 3 THEN CAST([0, 0, 10, 0, 10, 5, 0, 5] AS DOUBLE[]) WHEN f.frame % 3 > 0 THEN [c[1] + 0.5, c[2] - 0.25, c[3] + 0.5, c[4] - 0.25, c[5] + 0.5, c[6] - 0.25, c[7] + 0.5, c[8] - 0.25] ELSE c END
  FROM st JOIN fr f ON f.video_id = st.video_id AND f.frame = st.frame + 1)
SELECT video_id, frame, {", ".join(f"CASE WHEN c[{k + 1}] IS NOT NULL THEN {R(f'c[{k + 1}]')} END AS {name}" for k, name in enumerate(_CORNERS))} FROM st"""
QUERIES["ana13_model_sequence"] = lambda s, d: rounded(court.model_sequence(positions(s, d, dealt=True), dealt=True))
QUERIES["ana14_window_verdict"] = lambda s, d: court.window_verdicts(X.raw_positions(s, d, dealt=True), dealt=True)
#: Rules over all 29 frames of a window instead of its last 12.
_WHOLE = _TACTICS["ana5_label_clip"].replace(" WHERE (r.frame_id - 1) % 29 >= 17", "").replace("(r.frame_id - 1) % 29 - 17 AS i", "(r.frame_id - 1) % 29 AS i")
ORACLE_SQL["ana14_window_verdict"] = f"""WITH {POS}, v AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS sp FROM pos WINDOW w AS (PARTITION BY match_id, sequence, slot ORDER BY frame_id)),
g AS (SELECT match_id, sequence, coalesce(avg(sp), 0) < 2.0 OR count(x) / CAST(count(DISTINCT frame_id) AS DOUBLE) < 3.0 AS dead_ball FROM v GROUP BY 1, 2)
SELECT a.match_id, a.sequence, dead_ball, CASE WHEN dead_ball THEN 'Unclassified' ELSE label END AS label FROM ({_WHOLE}) a JOIN g ON g.match_id = a.match_id AND g.sequence = a.sequence"""
