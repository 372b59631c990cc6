"""Prefix scans against plain folds, chunk by chunk."""

import random

import numpy as np
import pytest

from courtline.operators import court, identity, learning, scan


def _close(got, want):
    return (got is None) == (want is None) and (got is None or np.allclose(got, want, rtol=1e-9, atol=1e-9))


@pytest.mark.parametrize("chunk", [4, 4096])
def test_camera_chain_is_a_plain_fold(spark, chunk):
    rng, rows, want = random.Random(1), [], {}
    for video, first in ((1, 1), (2, -40), (3, 5000)):
        now = None
        for t in range(first, first + 150):
            if rng.random() < 0.1:
                continue  # a missing frame
            corners = [rng.uniform(0, 900) for _ in range(8)] if rng.random() < 0.05 else None
            affine = [1 + rng.gauss(0, 0.01), rng.gauss(0, 0.01), rng.gauss(0, 3), rng.gauss(0, 0.01), 1 + rng.gauss(0, 0.01), rng.gauss(0, 3)] if rng.random() < 0.8 else None
            rows.append((video, t, corners, affine))
            if corners:
                now = np.array(corners).reshape(4, 2)
            elif now is not None and affine:
                m = np.array(affine).reshape(2, 3)
                now = now @ m[:, :2].T + m[:, 2]
            want[video, t] = None if now is None else now.reshape(-1)
    rows.append((9, 3, None, None))
    want[9, 3] = None
    df = spark.createDataFrame(rows, "video_id int, frame int, corners array<double>, affine array<double>")
    got = court.camera_chain(df.repartition(3), chunk)
    assert got.columns == ["video_id", "frame", "corners"] and dict(got.dtypes)["frame"] == "int"
    got = got.collect()
    assert len(got) == len(rows) and all(_close(r.corners, want[r.video_id, r.frame]) for r in got)
    assert court.camera_chain(df.where("false"), chunk).count() == 0


@pytest.mark.parametrize("chunk", [4, 4096])
def test_ball_is_a_plain_fold(spark, chunk):
    rng, rows, want, most, alpha = random.Random(2), [], {}, 5, 0.55
    for video in (1, 2):
        at, v = None, np.zeros(2)
        for t in range(0, 170):
            seen = rng.random() < 0.5 and not 60 < t < 90
            p = np.array([10.0 * t + rng.gauss(0, 5), rng.uniform(0, 50)]) if seen else None
            rows.append((video, t, *(p.tolist() if seen else (None, rng.choice([None, 4.0])))))
            if seen:
                if at is not None:
                    m = min(t - at[0] - 1, most)
                    v = alpha * (p - (at[1] + v * m)) + (1 - alpha) * v
                at = (t, p)
                want[video, t] = (p, False)
            else:
                ok = at is not None and t - at[0] <= most
                want[video, t] = (at[1] + v * (t - at[0]) if ok else None, ok)
    df = spark.createDataFrame(rows, "video_id long, frame long, ball_x double, ball_y double").repartition(3)
    got = identity.track_ball(df, most, alpha, chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        p, predicted = want[r.video_id, r.frame]
        assert _close(None if r.ball_x is None else [r.ball_x, r.ball_y], p) and r.predicted == predicted


@pytest.mark.parametrize("chunk", [3, 4096])
def test_calibration_is_the_last_known_one(spark, chunk):
    frames = [(v, t) for v in (1, 2) for t in range(0, 100, 1 + v)] + [(1, 4), (3, 7)]
    calibrations = [(1, t, None if t % 10 == 0 else float(t), 2.0) for t in range(5, 95, 5)] + [(2, 98, 1.0, None)]
    df = spark.createDataFrame(frames, "video_id long, frame long")
    cal = spark.createDataFrame(calibrations, "video_id long, frame long, scale double, tilt double")
    got = learning.calibration_asof(df, cal, ["scale", "tilt"], chunk=chunk).collect()

    def last(v, t):
        return max(((c[1], c[2], c[3]) for c in calibrations if c[0] == v and c[1] <= t and c[2] is not None), default=(None, None, None))[1:]

    assert sorted(map(str, ((r.video_id, r.frame, r.scale, r.tilt) for r in got))) == sorted(str((v, t, *last(v, t))) for v, t in frames)


def test_maps_compose_in_any_brackets():
    rng = np.random.default_rng(3)
    ball = np.full((40, 9), np.nan)
    for k in range(0, 40, 3):
        x = rng.random(2) * 100
        ball[k] = [k, *x, k, *x, 1, 0, 0]
    camera = np.concatenate([rng.random((40, 8)), rng.random((40, 6)), (rng.random((40, 1)) < 0.1).astype(float)], axis=1)
    for maps, compose in ((ball, scan.sightings(4, 0.3)), (camera, scan.moved)):
        one = maps[:1]
        for k in range(1, 40):
            one = compose(one, maps[k : k + 1])
        assert np.allclose(scan.running(maps, compose)[-1:], one, equal_nan=True)
        halves = compose(scan.running(maps[:17], compose)[-1:], scan.running(maps[17:], compose)[-1:])
        assert np.allclose(halves, one, equal_nan=True)
