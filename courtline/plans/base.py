"""What registered queries share: derived tables, rounding, and the common part of the oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import clean, frames

Query = Callable[[SparkSession, str], DataFrame]
CLIP_FRAME = ("match_id", "sequence", "frame_id")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded as the SQL twin rounds, without a negative zero.

    The value times a power of ten is rounded. F.round() with digits rounds the shortest decimal of a double instead, which differs
    where this ends on a five: 0.000035 to five digits is 0.00003 in SQL and 0.00004 there.
    """
    return F.round((F.col(c) if isinstance(c, str) else c) * 10.0**digits) / 10.0**digits + F.lit(0.0)


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """All doubles rounded; ``keep`` selects columns first."""
    df = df.select(*keep) if keep else df
    return df.select(*((r(c, digits).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


def R(e: str) -> str:  # noqa: N802 - the SQL twin of r()
    return f"(round({e}, 6) + CAST(0 AS DOUBLE))"


def positions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return clean.clean_positions(X.raw_positions(spark, sf_dir, dealt))


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.with_players(positions(spark, sf_dir))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.team_descriptor(frame_rows(spark, sf_dir))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.slot_velocity(positions(spark, sf_dir))


def frame_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frame_channels(positions(spark, sf_dir, dealt=True), dealt=True)


RAW = f"raw AS ({X.positions_sql()})"
_OK = "NOT ({x} = 0 AND {y} = 0) AND {x} BETWEEN -900 AND 2700 AND {y} BETWEEN -1800 AND 1800"
_P, _B = _OK.format(x="x", y="y"), _OK.format(x="ball_x", y="ball_y")
POS = f"""{RAW},
pos AS (SELECT match_id, frame_id, sequence, slot, CASE WHEN {_P} THEN x END AS x, CASE WHEN {_P} THEN y END AS y,
        CASE WHEN {_B} THEN ball_x END AS ball_x, CASE WHEN {_B} THEN ball_y END AS ball_y FROM raw),
pres AS (SELECT * FROM pos WHERE x IS NOT NULL AND y IS NOT NULL),
base AS (SELECT match_id, sequence, frame_id, max(ball_x) AS bx, max(ball_y) AS by FROM pos GROUP BY 1, 2, 3)"""
PAIRS = f"""{POS},
pairs AS (SELECT a.match_id, a.sequence, a.frame_id, a.slot AS s1, b.slot AS s2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
          FROM pres a JOIN pres b ON a.match_id = b.match_id AND a.frame_id = b.frame_id AND a.slot <> b.slot),
near AS (SELECT match_id, sequence, frame_id, s1, min(d) AS nn FROM pairs GROUP BY 1, 2, 3, 4),
nn AS (SELECT match_id, frame_id, avg(nn) AS nn_mean, min(nn) AS nn_min, max(nn) AS nn_max FROM near GROUP BY 1, 2),
far AS (SELECT match_id, frame_id, max(d) AS max_pair FROM pairs GROUP BY 1, 2),
pts AS (SELECT DISTINCT match_id, frame_id, x, y FROM pres),
edges AS (SELECT a.match_id, a.frame_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by
          FROM pts a JOIN pts b ON a.match_id = b.match_id AND a.frame_id = b.frame_id AND (a.x <> b.x OR a.y <> b.y)
          WHERE NOT EXISTS (SELECT 1 FROM pts k WHERE k.match_id = a.match_id AND k.frame_id = a.frame_id
                            AND NOT (k.x = a.x AND k.y = a.y) AND NOT (k.x = b.x AND k.y = b.y)
                            AND NOT ((b.x - a.x) * (k.y - a.y) - (b.y - a.y) * (k.x - a.x) > 0
                                     OR ((b.x - a.x) * (k.y - a.y) - (b.y - a.y) * (k.x - a.x) = 0 AND (k.x - a.x) * (k.x - b.x) + (k.y - a.y) * (k.y - b.y) <= 0)))),
npt AS (SELECT match_id, frame_id, count(*) AS n FROM pts GROUP BY 1, 2),
hull AS (SELECT e.match_id, e.frame_id, CASE WHEN max(n) < 3 THEN 0 ELSE abs(sum(ax * e.by - e.bx * ay)) / 2 END AS area
         FROM edges e JOIN npt ON npt.match_id = e.match_id AND npt.frame_id = e.frame_id GROUP BY 1, 2),
cen AS (SELECT match_id, frame_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM pres GROUP BY 1, 2),
descr AS (SELECT b.match_id, b.sequence, b.frame_id,
    CASE WHEN b.bx IS NULL OR b.by IS NULL THEN CAST(0 AS DOUBLE) ELSE 1 END AS ball_present, coalesce(b.bx, 0) AS ball_x, coalesce(b.by, 0) AS ball_y,
    coalesce(cx, 0) AS centroid_x, coalesce(cy, 0) AS centroid_y, CASE WHEN c.n > 1 THEN sx ELSE 0 END AS spread_x, CASE WHEN c.n > 1 THEN sy ELSE 0 END AS spread_y,
    coalesce(area, 0) AS hull_area, coalesce(nn_mean, 0) AS nn_dist_mean, coalesce(nn_min, 0) AS nn_dist_min, coalesce(nn_max, 0) AS nn_dist_max,
    coalesce(max_pair, 0) AS max_pair_dist, CAST(coalesce(c.n, 0) AS DOUBLE) AS n_present,
    CASE WHEN b.bx IS NULL OR c.n IS NULL THEN 0 ELSE sqrt((cx - b.bx) * (cx - b.bx) + (cy - b.by) * (cy - b.by)) END AS ball_to_centroid
  FROM base b LEFT JOIN cen c ON c.match_id = b.match_id AND c.frame_id = b.frame_id LEFT JOIN nn ON nn.match_id = b.match_id AND nn.frame_id = b.frame_id
  LEFT JOIN far ON far.match_id = b.match_id AND far.frame_id = b.frame_id LEFT JOIN hull ON hull.match_id = b.match_id AND hull.frame_id = b.frame_id)"""
MOVES = f"""{POS},
vel AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM pos WINDOW w AS (PARTITION BY match_id, sequence, slot ORDER BY frame_id)),
mov AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM vel),
ranked AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_id ORDER BY speed DESC, slot DESC) AS rk FROM mov WHERE speed IS NOT NULL),
tops AS (SELECT match_id, frame_id, avg(CASE WHEN rk <= 2 THEN speed END) AS t2, avg(CASE WHEN rk BETWEEN 3 AND 6 THEN speed END) AS b4 FROM ranked GROUP BY 1, 2),
cosp AS (SELECT a.match_id, a.sequence, a.frame_id, (a.vx * b.vx + a.vy * b.vy) / (a.speed * b.speed) AS c
         FROM ranked a JOIN ranked b ON a.match_id = b.match_id AND a.frame_id = b.frame_id AND a.slot < b.slot WHERE a.speed >= 1e-6 AND b.speed >= 1e-6),
cosf AS (SELECT match_id, frame_id, avg(c) AS c, count(*) AS n_pairs, sum(c) AS sum_cos FROM cosp GROUP BY 1, 2),
kin AS (SELECT b.match_id, b.sequence, b.frame_id, coalesce(t2, 0) AS speed_top2, coalesce(b4, 0) AS speed_bot4, coalesce(t2, 0) - coalesce(b4, 0) AS speed_diff, coalesce(c, 0) AS sync_inst
        FROM base b LEFT JOIN tops t ON t.match_id = b.match_id AND t.frame_id = b.frame_id LEFT JOIN cosf c ON c.match_id = b.match_id AND c.frame_id = b.frame_id)"""
#: Both of the above.
BOTH = PAIRS + MOVES.removeprefix(POS)
