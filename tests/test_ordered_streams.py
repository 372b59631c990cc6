"""Stream folds against their batch operators: rows in any order, a restart in the middle, late rows aside."""

import math
import random

import pytest
from pyspark.sql import functions as F

from courtline.operators import colours, identity, teams
from courtline.streaming import ordered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAR_ON = 100_000  # a frame of another key that moves the watermark past everything


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def _run(spark, tmp_path, name, rows, schema, build, batches):
    """Rows in micro-batches, half of them before the query is stopped and started again from its checkpoint."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for half in (batches[: len(batches) // 2], batches[len(batches) // 2 :]):
        for batch in half:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = build(stream).writeStream.format("parquet").option("path", sink).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None and not q.isActive
    return spark.read.parquet(sink)


def _jumbled(rng, rows, frame, reach=40, size=90):
    """Micro-batches of rows that come up to ``reach`` frames out of order."""
    rows = sorted(rows, key=lambda r: r[frame] + rng.uniform(0, reach))
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def _plain(rows):
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


def test_identity(spark, tmp_path):
    rng, rows = random.Random(1), []
    for clip in (0, 1, 2):
        at = [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(6)]
        for t in range(29 * clip + 1, 29 * clip + 30):
            at = [(x + rng.gauss(0, 30), y + rng.gauss(0, 30)) for x, y in at]
            for slot, p in enumerate(rng.sample(at, 6), 1):
                rows.append((1, clip, t, slot, *(p if rng.random() < 0.85 else (None, None))))
    schema = "match_id long, sequence long, frame_id long, slot int, x double, y double"
    whole = {}
    for r in rows:
        whole.setdefault(r[:3], []).append(r)
    frames = sorted(whole.values(), key=lambda f: f[0][2] + rng.uniform(0, 40))  # frames are jumbled, and rows inside them
    batches = [[r for f in frames[k : k + 9] for r in rng.sample(f, len(f))] for k in range(0, len(frames), 9)]
    batches += [[(9, 9, FAR_ON, 1, 1.0, 1.0)], [rows[7]], [(9, 9, FAR_ON + 1, 1, 1.0, 1.0)]]
    got = _run(spark, tmp_path, "identity", rows, schema, lambda s: ordered.live_identity(s, 150.0), batches)
    assert [(r.match_id, r.sequence, r.frame_id, r.slot) for r in got.where("late").collect()] == [rows[7][:4]]
    want = identity.recover_identity(spark.createDataFrame(rows, schema), 150.0)
    clean = lambda df: _plain(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.select("match_id", "sequence", "frame_id", "slot", "x", "y").collect())
    assert clean(got.where("match_id = 1 and not late")) == clean(want)


def test_slots(spark, tmp_path):
    rng, rows = random.Random(2), []
    for track in range(1, 14):
        t, x, y = rng.randrange(1, 120), rng.uniform(0, 900), rng.uniform(0, 900)
        for _ in range(rng.randrange(20, 160)):
            t, x, y = t + 1 + (rng.random() < 0.05) * rng.randrange(30), x + rng.gauss(0, 20), y + rng.gauss(0, 20)
            rows.append((1 + track % 2, t, track, x, y))
    rows += [(1, 900, 3, 5.0, 5.0), (1, 901, 4, None, 5.0), (2, 902, 4, 5.0, float("nan"))]
    schema = "video_id long, frame long, track_id long, x double, y double"
    batches = [*_jumbled(rng, rows, 1), [(9, FAR_ON, 1, 1.0, 1.0)], [rows[0]], [(9, FAR_ON + 1, 1, 1.0, 1.0)]]
    got = _run(spark, tmp_path, "slots", rows, schema, ordered.live_slots, batches)
    assert [(r.video_id, r.frame, r.track_id, r.slot) for r in got.where("late").collect()] == [(*rows[0][:3], 0)]
    want = identity.manage_slots(spark.createDataFrame(rows, schema))
    columns = ["video_id", "frame", "track_id", "x", "y", "slot"]
    assert _plain(got.where("video_id < 9 and not late").select(columns).collect()) == _plain(want.select(columns).collect())


def test_votes(spark, tmp_path):
    rng, rows = random.Random(3), []
    for t in range(1, 150):
        for track in range(8):
            if rng.random() < 0.9:
                rows.append((1 + track % 2, t, 10 * track + 1, track, rng.choice(["NEAR", "NEAR", "FAR", "UNKNOWN"])))
    schema = "video_id long, frame long, det_id long, track_id long, team string"
    batches = [*_jumbled(rng, rows, 1, 30, 150), [(9, FAR_ON, 1, 1, "NEAR")], [rows[3]], [(9, FAR_ON + 1, 1, 1, "NEAR")]]
    got = _run(spark, tmp_path, "votes", rows, schema, lambda s: ordered.live_votes(s, ratio=1.5), batches)
    assert [(r.video_id, r.frame, r.det_id, r.voted) for r in got.where("late").collect()] == [(*rows[3][:3], None)]
    want = teams.team_votes(spark.createDataFrame(rows, schema), ratio=1.5)
    columns = ["video_id", "frame", "det_id", "track_id", "near", "far", "voted"]
    assert _plain(got.where("video_id < 9 and not late").select(columns).collect()) == _plain(want.select(columns).collect())


def test_colours(spark, tmp_path):
    rng, rows = random.Random(4), []
    for video in (1, 2, 3):  # the third has one team only
        for t in range(1, 90):
            for det in range(4):
                near = det % 2 == 0 or video == 3
                if rng.random() < 0.8:
                    y = rng.uniform(500, 900) if near else rng.uniform(0, 400)
                    rows.append((video, t, det, y if rng.random() < 0.95 else None, rng.gauss(0.8 if near else -0.5, 0.1), rng.gauss(0, 0.1), rng.random()))
    schema = "video_id long, frame long, det_id long, y double, cx double, cy double, cv double"
    batches = [*_jumbled(rng, rows, 1, 30, 150), [(9, FAR_ON, 1, 1.0, 0.0, 0.0, 0.0)], [rows[5]], [(9, FAR_ON + 1, 1, 1.0, 0.0, 0.0, 0.0)]]
    got = _run(spark, tmp_path, "colours", rows, schema, ordered.live_video_teams, batches)
    assert [(r.video_id, r.frame, r.det_id) for r in got.where("late").collect()] == [rows[5][:3]]
    want = colours.video_teams(spark.createDataFrame(rows, schema))
    columns = ["video_id", "frame", "det_id", "team", "by_colour"]
    got = got.where("video_id < 9 and not late")
    assert _plain(got.select(columns).collect()) == _plain(want.select(columns).collect())
    assert {(r[0], r[1]) for r in got.select("video_id", "by_colour").distinct().collect()} == {(1, True), (1, False), (2, True), (2, False), (3, False)}


def test_states_are_removed(spark, tmp_path):
    rows = [(1, t, 1, "NEAR") for t in range(1, 20)]
    schema = "video_id long, frame long, track_id long, team string"
    batches = [[r] for r in rows[::6]] + [[(9, FAR_ON, 1, "NEAR")], [(9, FAR_ON + 1, 1, "NEAR")]]
    _run(spark, tmp_path, "removed", rows, schema, lambda s: ordered.live_votes(s.withColumn("det_id", F.lit(1))), batches)
    state = spark.read.format("statestore").option("stateVarName", "done").load(str(tmp_path / "state"))
    assert {r.key[0] for r in state.select("key").collect()} <= {9}
