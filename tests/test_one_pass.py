"""What larger tables showed: tables computed over and over, windows over whole tracks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.operators import clips, colours, court, frames, measures, pose, rules

KEYS = ["match_id", "sequence"]


def _scans(df) -> int:
    """How often the plan reads a written table."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def _court(spark, folder, seed=0):
    """Clips with gaps, in slots 1 to 6, of 29 frames or fewer, as a written table."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(40):
        still = rng.random() < 0.3
        for t in range(29 if c % 5 else 1 + c % 9):
            ball = (float(rng.integers(0, 1800)), float(rng.integers(300, 900))) if rng.random() < 0.9 else (0.0, 0.0)
            for k in range(1, 7):
                at = (300.0 * k + (0 if still else rng.integers(0, 5 + 20 * (c % 4))), 400.0 + rng.integers(0, 9 + 40 * (c % 3)))
                rows.append((c % 3, c, c * 29 + t + 1, k, *(map(float, at) if rng.random() < 0.85 else (0.0, 0.0)), *ball))
    spark.createDataFrame(rows, "match_id long, sequence long, frame_id long, slot int, x double, y double, ball_x double, ball_y double").repartition(3).write.mode("overwrite").parquet(f"{folder}/court")
    return spark.read.parquet(f"{folder}/court")


def _plain(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("parity", [True, False])
def test_rules_in_one_pass(spark, tmp_path, parity):
    raw = _court(spark, tmp_path)
    got = rules.label_clips(raw, parity=parity)
    assert _scans(got) == 1
    want = rules.attack_rule(raw, parity=parity).join(rules.defense_rule(raw), KEYS).join(rules.delayed_rule(raw, parity=parity), KEYS).join(rules.spacing_rule(raw), KEYS)
    assert _plain(got.drop("label")) == _plain(want)
    assert all(len({r[c] for r in want.collect()}) == 2 for c in ("delayed", "spacing"))


def test_whole_windows_in_one_pass(spark, tmp_path):
    raw = _court(spark, tmp_path)
    got = frames.whole_windows(raw)
    assert _scans(got) == 1
    full = raw.groupBy(*KEYS).agg(F.count_distinct("frame_id").alias("n")).where("n = 29")
    assert got.columns == raw.columns and _plain(got) == _plain(raw.join(full, KEYS, "left_semi").select(raw.columns))


def test_reaction_lag_in_one_pass(spark, tmp_path):
    from courtline.operators import clean

    at = clean.clean_positions(_court(spark, tmp_path))
    got = measures.reaction_lag(at)
    assert _scans(got) == 1
    rows, want = {}, {}
    for r in at.collect():
        rows.setdefault((r.match_id, r.sequence), {}).setdefault(r.frame_id, []).append(r)
    for key, of in rows.items():
        want[key] = None
        order = sorted(of)
        ball = [(max((r.ball_x for r in of[f] if r.ball_x is not None), default=None), max((r.ball_y for r in of[f] if r.ball_y is not None), default=None)) for f in order]
        dy = [None if k == 0 or ball[k][1] is None or ball[k - 1][1] is None else ball[k][1] - ball[k - 1][1] for k in range(len(order))]
        turns = [k - 1 for k in range(1, len(order)) if dy[k] is not None and dy[k - 1] is not None and dy[k] * dy[k - 1] <= 0]
        if not turns or sum(b[1] is not None for b in ball) < 3 or ball[turns[0]][0] is None:
            continue
        near = min(((np.hypot(r.x - ball[turns[0]][0], r.y - ball[turns[0]][1]), r.slot) for r in of[order[turns[0]]] if r.x is not None), default=None)
        if near is None:
            continue
        path = [next(r for r in of[f] if r.slot == near[1]) for f in order]
        steps = [(-np.sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), k) for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if a.x is not None and b.x is not None]
        want[key] = float(min(steps)[1] - turns[0]) if steps else None
    assert {(r.match_id, r.sequence): r.reaction_lag_frames for r in got.collect()} == want and len(set(want.values())) > 5


def test_zscores_in_one_pass(spark, tmp_path):
    rows = _court(spark, tmp_path).where("slot = 1").select(*KEYS, "frame_id", "x", "y", F.lit(3.0).alias("flat"))
    names = ("x", "y", "flat")
    got, want = (sorted(map(tuple, df.select(*KEYS, "frame_id", "channel", "v", F.round("z", 9)).collect())) for df in (clips.zscored_channels(rows, names), clips.zscore(clips.channels(rows, names))))
    assert got == want and {r[5] for r in got if r[3] == "flat"} == {0.0}


def test_padding_in_one_pass(spark, tmp_path):
    rows = _court(spark, tmp_path).where("slot = 1").select(*KEYS, "frame_id", F.when(F.col("frame_id") % 7 > 0, F.col("x")).alias("x"), "y").where("frame_id % 5 <> 3")
    got = clips.pad_windows(rows, 20)
    assert _scans(got) == 1
    first, want = {}, {}
    own = {(r.match_id, r.sequence, r.frame_id): (r.x or 0.0, r.y) for r in rows.collect()}
    for m, s, f in own:
        first[m, s] = min(f, first.get((m, s), f))
    want = sorted((m, s, t, *own.get((m, s, f + t), (0.0, 0.0))) for (m, s), f in first.items() for t in range(20))
    assert sorted(map(tuple, got.collect())) == want


def test_colours_are_taken_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(v, f, d, float(rng.integers(0, 900)), *(float(x) for x in rng.random(3).round(2))) for v in (1, 2) for f in range(80) for d in range(3)]
    taken = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            taken.add(b.num_rows)
            yield b

    schema = "video_id long, frame long, det_id int, y double, cx double, cy double, cv double"
    got = colours.video_teams(spark.createDataFrame(rows, schema).mapInArrow(count, schema)).collect()
    assert len(got) == taken.value == len(rows)


def test_model_sequence_links_once(spark, tmp_path):
    got = court.model_sequence(_court(spark, tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and got.count() == 40 * 29


@pytest.mark.parametrize("chunk", [4, 9, 4096])
def test_pose_in_chunks(spark, chunk):
    rng = np.random.default_rng(chunk)
    point = lambda x, y, c: (float(x), float(y), float(c))
    rows, want = [], {}
    for v, k in ((1, 1), (1, 2), (2, 1)):
        hip = angle = None
        ema, flew = 0.0, False
        for t in sorted(rng.choice(120, 70, replace=False).tolist()):
            y, a, sure, arm = float(rng.integers(0, 60)), float(rng.uniform(-3, 3)), rng.random() < 0.8, rng.random() < 0.8
            kp = [point(0, 0, 0)] * 17
            kp[5], kp[9], kp[11] = point(100, 100, arm), point(100 + 50 * np.cos(a), 100 + 50 * np.sin(a), arm), point(100, y, sure)
            rows.append((v, t, k, (0.0, 0.0, 50.0, 185.0), kp))
            vy = 0.0
            if sure and hip is not None:
                ema = vy = 0.5 * -(y - hip) * (1.85 / 185) * 30 + 0.5 * ema
            turn = abs((a - angle + np.pi) % (2 * np.pi) - np.pi) * 30 if arm and angle is not None else 0.0
            want[v, k, t] = vy, turn, vy > 1.8 and not flew
            hip, angle, flew = y if sure else None, a if arm else None, vy > 1.8
    df = spark.createDataFrame(rows, "video_id long, frame long, track_id long, box struct<x1:double,y1:double,x2:double,y2:double>, kp array<struct<x:double,y:double,conf:double>>").repartition(3)
    got = {(r.video_id, r.track_id, r.frame): (r.vy_ms, r.arm_omega_rad_s, r.takeoff) for r in pose.pose_motion(df, chunk=chunk).collect()}
    assert got.keys() == want.keys() and sum(x[2] for x in want.values()) > 5
    assert all(np.allclose(got[k][:2], want[k][:2], atol=1e-9) and got[k][2] == want[k][2] for k in want)
