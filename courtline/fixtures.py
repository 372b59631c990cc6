"""Court tables derived from the order tables, for queries, tests and benchmarks.

An order is a frame, its lines are the players and the customer's nation is the match. One SQL
text serves Spark and an ANSI SQL oracle alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw positions: (0, 0) stands for missing; one row per frame and slot.
POSITIONS = """
WITH pl AS (
  SELECT l_orderkey, l_quantity, l_partkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS slot
  FROM {lineitem}),
fr AS (
  SELECT o.o_orderkey, c.c_nationkey AS match_id, o.o_orderstatus, o.o_totalprice,
         CAST(row_number() OVER (PARTITION BY c.c_nationkey ORDER BY o.o_orderdate, o.o_orderkey) AS BIGINT) AS frame_id,
         CASE c.c_nationkey % 4 WHEN 0 THEN CAST(0.02 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(4 AS DOUBLE) ELSE CAST(12 AS DOUBLE) END AS amp
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey)
SELECT f.match_id, f.frame_id, CAST(floor((f.frame_id - 1) / CAST(29 AS DOUBLE)) AS BIGINT) AS sequence,
       CAST(s.slot AS INT) AS slot,
       CASE WHEN p.slot IS NULL THEN CAST(0 AS DOUBLE)
            ELSE 150 + 250 * (s.slot - 1) + f.amp * p.l_quantity END AS x,
       CASE WHEN p.slot IS NULL THEN CAST(0 AS DOUBLE)
            ELSE 480 + 120 * (s.slot % 3) + f.amp * (p.l_partkey % 20) END AS y,
       CASE WHEN f.o_orderstatus = 'P' THEN CAST(0 AS DOUBLE) ELSE CAST(CAST(round(f.o_totalprice * 100) AS BIGINT) % 180000 AS DOUBLE) / 100 END AS ball_x,
       CASE WHEN f.o_orderstatus = 'P' THEN CAST(0 AS DOUBLE) ELSE CAST((f.o_orderkey * 37) % 900 AS DOUBLE) END AS ball_y
FROM fr f CROSS JOIN (SELECT 1 AS slot UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) s
LEFT JOIN pl p ON p.l_orderkey = f.o_orderkey AND p.slot = s.slot
"""

#: Person boxes around the players who are there, and one or two balls a frame.
DETECTIONS = """
SELECT match_id AS video_id, frame_id AS frame, 'person' AS kind, slot AS det_id,
       CAST((slot + CAST(floor(frame_id / CAST(40 AS DOUBLE)) AS BIGINT)) % 9 AS BIGINT) AS track_id,
       x * 0.6 - 15 AS x1, y * 0.6 - 60 AS y1, x * 0.6 + 15 AS x2, y * 0.6 AS y2,
       CAST((CAST(floor(x * 10) AS BIGINT) * 7 + CAST(floor(y * 10) AS BIGINT) * 13 + frame_id) % 100 AS DOUBLE) / 100 AS conf
FROM {positions} WHERE NOT (x = 0 AND y = 0)
UNION ALL
SELECT match_id, frame_id, 'ball', 100 + slot, CAST(NULL AS BIGINT), ball_x * 0.6 - 5, ball_y * 0.6 - 5, ball_x * 0.6 + 5 + slot, ball_y * 0.6 + 5,
       CAST((CAST(floor(ball_x * 10) AS BIGINT) * slot + frame_id) % 100 AS DOUBLE) / 100
FROM {positions} WHERE NOT (ball_x = 0 AND ball_y = 0) AND slot <= 1 + frame_id % 2
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


#: The frames of POSITIONS, which come before its slots.
_FRAMES = "SELECT * FROM " + POSITIONS[POSITIONS.index("fr AS (") + len("fr AS ") : POSITIONS.index("SELECT f.match_id")].rstrip() + " f"


def raw_positions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The rows of POSITIONS. An order's lines stay packed in one row, and slots become rows last, so little is exchanged.

    dealt: frames are dealt by match_id and sequence, with all their columns whatever is read of them, so branches of one plan share
    the exchange and what is taken per clip needs no other.
    """
    t = tables(spark, sf_dir, "lineitem", "orders", "customer")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    lines = t["lineitem"].where("l_orderkey is not null").select("l_orderkey", line.alias("line")).repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list("line")), 1, 6).alias("lines"))
    lines = lines.select("l_orderkey", F.transform("lines", lambda p: F.struct(p["l_quantity"].alias("q"), (p["l_partkey"] % 20).cast("int").alias("part"))).alias("p"))
    frames = spark.sql(_FRAMES, **{n: t[n] for n in ("orders", "customer")}).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ball = F.col("o_orderstatus") != "P"

    def cell(slot):
        p, there = F.get("p", slot - 1), slot <= F.coalesce(F.size("p"), F.lit(0))
        x, y = 150 + 250 * (slot - 1) + F.col("amp") * p["q"], 480 + 120 * (slot % 3) + F.col("amp") * p["part"]
        return F.struct(slot.alias("slot"), F.when(there, x).otherwise(0.0).alias("x"), F.when(there, y).otherwise(0.0).alias("y"), "ball_x", "ball_y")

    frames = frames.withColumn("sequence", F.floor((F.col("frame_id") - 1) / 29.0).cast("long"))
    frames = frames.withColumn("ball_x", F.when(ball, (F.round(F.col("o_totalprice") * 100).cast("long") % 180000).cast("double") / 100).otherwise(0.0))
    frames = frames.withColumn("ball_y", F.when(ball, ((F.col("o_orderkey") * 37) % 900).cast("double")).otherwise(0.0))
    frames = frames.select("match_id", "frame_id", "sequence", F.transform(F.sequence(F.lit(1), F.lit(6)), cell).alias("cells"))
    frames = frames.repartition("match_id", "sequence") if dealt else frames
    return frames.select("match_id", "frame_id", "sequence", F.inline("cells"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETECTIONS, positions=raw_positions(spark, sf_dir))


def positions_sql() -> str:
    return POSITIONS.replace("{", "").replace("}", "")


def detections_sql() -> str:
    return DETECTIONS.replace("{positions}", "raw")
