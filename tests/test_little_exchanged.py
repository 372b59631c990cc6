"""What filled disks: pixels and slots exchanged row by row, tables read twice, rows copied for every block of queries."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline import fixtures
from courtline.operators import clips, colours, court, frames, identity, neighbours, teams
from courtline.plans import colours as colour_plans
from courtline.plans import models as model_plans


def _exchanges(df) -> int:
    """Exchanges of the plan before it runs, without broadcasts."""
    return sum("Exchange hashpartitioning" in x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines()) + sum("Exchange hashpartitioning" in x for x in df._jdf.queryExecution().executedPlan().toString().splitlines())


@pytest.mark.parametrize("dealt", [False, True])
def test_raw_positions_are_those_of_sql(spark, sf_dir, dealt):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = fixtures.raw_positions(spark, sf_dir, dealt)
    assert got.dtypes == spark.sql(fixtures.POSITIONS, **fixtures.tables(spark, sf_dir, "lineitem", "orders", "customer")).dtypes
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(fixtures.positions_sql()).fetchall())


def test_pixels_are_not_exchanged(spark, sf_dir):
    whole, boxes = colour_plans._colours(spark, sf_dir), colour_plans._people(spark, sf_dir)
    assert _exchanges(whole) == _exchanges(boxes)
    want = colours.torso_colours(boxes, spark.sql(colour_plans._PIXELS, det=boxes))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, want.select(whole.columns).collect()))


def test_pixels_of_a_box(spark):
    box = [(1, 1, 1, 0.0, 0.0, 40.0, 100.0), (1, 1, 2, 0.0, 0.0, 1.0, 90.0), (1, 1, 3, 0.0, 0.0, 40.0, 100.0)]
    inside = [(20, 30, 45.0, 255.0, 51.0), (21, 30, 45.0, None, 51.0), (22, 30, 45.0, 255.0, 255.0), (10, 15, 45.0, 255.0, 51.0), (30, 30, 0.0, 0.0, 0.0), (20, 50, 0.0, 0.0, 0.0)]
    rows = [(*b, p) for b, p in zip(box, (inside, [(0, 30, 9.0, 9.0, 9.0)], []), strict=True)]
    df = spark.createDataFrame(rows, "video_id long, frame long, det_id int, x1 double, y1 double, x2 double, y2 double, pixels array<struct<px:int,py:int,h:double,s:double,v:double>>")
    got = {r.det_id: (r.cx, r.cy, r.cv) for r in colours.torso_colours(df).collect()}
    assert got[1] == pytest.approx((0.0, 1.0, 0.2), abs=1e-12) and got[2] == got[3] == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("forget", [True, False])
def test_votes_of_clips_are_those_of_videos(spark, forget):
    rng = np.random.default_rng(1)
    rows = [(v, int(f), t, ("NEAR", "FAR", "UNKNOWN")[rng.integers(0, 3)]) for v in (1, 2) for t in (1, 2, None) for f in sorted(rng.choice(5000, 4600, replace=False)) if f < 2000 or f % 7]
    df = spark.createDataFrame(rows, "video_id long, frame long, track_id long, team string")
    got, want = (sorted(((r.video_id, r.frame, r.track_id or 0, r.near, r.far, r.voted) for r in x.collect())) for x in (teams.track_votes(df, forget=forget), teams.team_votes(df, forget=forget)))
    assert [r[:3] + r[5:] for r in got] == [r[:3] + r[5:] for r in want]
    assert np.allclose([r[3:5] for r in got], [r[3:5] for r in want], rtol=1e-9)


def test_clips_are_dealt_once(spark, sf_dir):
    verdicts = court.window_verdicts(fixtures.raw_positions(spark, sf_dir, True), dealt=True)
    raw = _exchanges(fixtures.raw_positions(spark, sf_dir, True))
    assert _exchanges(verdicts) <= 2 * raw  # gate and rules; the second is the first once it runs
    verdicts.collect()
    assert "ReusedExchange" in verdicts._jdf.queryExecution().executedPlan().toString()
    assert _exchanges(model_plans.QUERIES["ana14_model_verdict"](spark, sf_dir)) <= 2 * raw


def test_rows_are_copied_for_their_own_queries_alone(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(2)
    points = rng.normal(0, 200, (30, 5))[rng.integers(0, 30, 3000)] + rng.normal(0, 1, (3000, 5))
    table = spark.createDataFrame([(i, i % 3, p.tolist()) for i, p in enumerate(points)], "vec_id long, label int, embedding array<double>")
    read = spark.sparkContext.accumulator(0)
    plain = neighbours._compare

    def counted(k):
        inner = plain(k)

        def compare(queries, rows):
            read.add(rows.num_rows)
            return inner(queries, rows)

        return compare

    monkeypatch.setattr(neighbours, "_compare", counted)
    got = {(r.query_id, r.rank): r.vec_id for r in neighbours.knn(table.where("vec_id % 3 = 0"), table).collect()}
    d = ((points[::3, None] - points[None]) ** 2).sum(-1)
    d[np.arange(1000), np.arange(0, 3000, 3)] = np.inf
    want = d.argsort(axis=1)[:, :5]
    assert got == {(3 * i, k + 1): int(want[i, k]) for i in range(1000) for k in range(5)}
    assert read.value < 8 * 3000  # 20 blocks of queries, each against all rows twice, before


def test_model_sequence_reads_its_rows_once(spark, tmp_path):
    rng = np.random.default_rng(7)
    lost = lambda p, v: v if rng.random() < p else None
    rows = []
    for c in range(6):
        for t in range(29 if c else 11):
            ball = lost(0.6, (float(rng.integers(0, 1800)), float(rng.integers(0, 900)))) or (None, None)
            for k in range(1, 7):
                at = lost(0.8, (300.0 * k + float(rng.integers(0, 30)), 400.0 + float(rng.integers(0, 90)))) or (None, None)
                rows.append((1, c, 29 * c + t + 1, k, *at, *ball))
    spark.createDataFrame(rows, "match_id long, sequence long, frame_id long, slot int, x double, y double, ball_x double, ball_y double").write.parquet(f"{tmp_path}/at")
    table = spark.read.parquet(f"{tmp_path}/at")
    got = court.model_sequence(table)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    k = ["match_id", "sequence", "frame_id"]
    ball = frames.interpolate_gaps(table.groupBy(*k).agg(F.max("ball_x").alias("x"), F.max("ball_y").alias("y")).withColumn("slot", F.lit(0)))
    players = frames.interpolate_gaps(identity.recover_identity(table)).drop("filled")
    joined = frames.frame_channels(players.join(ball.select(*k, F.col("x").alias("ball_x"), F.col("y").alias("ball_y")), k))
    want = clips.pad_windows(joined.select(*k, *clips.MODEL_CHANNELS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
