"""Replayed streams at any size: files hold a stretch of frames, state holds what the watermark hasn't passed, tables where nobody moves."""

import datetime
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from courtline.plans import formation, learning, models, teams
from courtline.streaming import ordered


def test_files_of_a_stretch(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(teams, "STRETCH", 32)
    top = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(top))
    got = teams.QUERIES["stf4_live_team_vote"](spark, sf_dir)
    (new,) = (x for x in set(os.listdir(top)) - before if x.startswith("replay-"))
    spans = spark.read.parquet(f"{top}/{new}/in").where("video_id >= 0").groupBy(F.input_file_name()).agg((F.max("frame") - F.min("frame")).alias("span")).collect()
    assert len(spans) > 4 and max(r.span for r in spans) < 32
    assert got.where("late").count() == 0
    columns = ["video_id", "frame", "det_id", "near", "far", "voted"]
    want = teams.QUERIES["stf4_team_vote"](spark, sf_dir)
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


def test_faded_sums():
    rng = np.random.default_rng(5)
    votes, anew = rng.random(3000), rng.random(3000) < 0.002
    start = np.maximum.accumulate(np.where(anew, np.arange(3000), 0))
    want, last = [], 0.0
    for v, s, k in zip(votes, start, range(3000), strict=True):
        last = v + (0.0 if s == k else last * 0.98)
        want.append(last)
    assert np.allclose(ordered.faded_sums(votes, start, 0.98), want, rtol=1e-13)


def test_packed_rows():
    rows = pd.DataFrame({"t": [5, 3], "x": [None, 2.5], "team": ["NEAR", None]})
    first, last, data = ordered.packed(rows)
    back = ordered.unpacked(data)
    assert (first, last, list(back["t"])) == (3, 5, [5, 3]) and np.isnan(back["x"][0]) and back["team"][1] is None


@pytest.fixture(scope="module")
def still(spark, tmp_path_factory):
    """Tables of four matches; in every second window the same order comes again and again, so nobody moves."""
    top, day = str(tmp_path_factory.mktemp("still")), datetime.datetime(2024, 1, 1)
    orders, lines = [], []
    for match in range(4):
        for k in range(29 * 6):
            order, same = 1000 * match + k, k // 29 % 2
            orders.append((order, match, "O", 100.0 + k, day + datetime.timedelta(days=k)))
            lines += [(order, n, float(10 + n + (0 if same else (k * 7 + n * 3) % 11)), 5 * n + (0 if same else k * n % 13), 1, day, 1.0) for n in range(1, 6)]
    tables = {
        "customer": ([(m, m) for m in range(4)], "c_custkey long, c_nationkey int"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"),
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_quantity double, l_partkey long, l_suppkey long, l_shipdate timestamp, l_extendedprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return top


def test_windows_of_players_who_stand(spark, still):
    rows = formation.QUERIES["agg4_window_metrics"](spark, still).collect()
    assert len(rows) == 24 and {r.sync_score for r in rows if r.sequence % 2} == {0.0} and any(r.sync_score for r in rows)


def test_models_of_players_who_stand(spark, still):
    clips = learning._clips(spark, still)
    assert clips.count() == 24 and clips.where("sync_score = 0").count() >= 12
    assert learning.QUERIES["ml4_kfold_predict"](spark, still).count() == 24
    assert models.QUERIES["ml9_batch_score"](spark, still).count() == 24
    assert teams.QUERIES["ana8_tactical_deviation"](spark, still).count() == 24
