"""Closed-form cases of the court operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.functions import geometry as G
from courtline.functions import scalars as S
from courtline.operators import clean, events, frames, identity, learning, neighbours, roles, rules, scores, teams, thinning

POS = "match_id long, sequence long, frame_id long, slot int, x double, y double, ball_x double, ball_y double"


def positions(spark, paths, ball=None):
    """paths: for each slot a list of (x, y) or None, one per frame."""
    rows = []
    for slot, path in enumerate(paths, 1):
        for t, p in enumerate(path):
            b = ball[t] if ball else None
            rows.append((1, 0, t + 1, slot, *(p or (None, None)), *(b or (None, None))))
    return spark.createDataFrame(rows, POS)


def one(df):
    return df.first().asDict()


def test_descriptor_does_not_depend_on_slots(spark):
    rng = random.Random(1)
    points = [(100.0, 200.0), (500.0, 250.0), (450.0, 700.0), (90.0, 600.0)]
    seen = set()
    for _ in range(5):
        rng.shuffle(points)
        got = one(frames.team_descriptor(clean.with_players(positions(spark, [[p] for p in points] + [[None], [None]], [(300.0, 400.0)]))))
        seen.add(tuple(round(v, 9) for k, v in sorted(got.items())))
    assert len(seen) == 1


@pytest.mark.parametrize(("points", "area"), [([(0, 0), (10, 0), (10, 10), (0, 10)], 100), ([(0, 0), (5, 5), (10, 10)], 0), ([(0, 0), (1, 1)], 0), ([(0, 0), (10, 0), (5, 0), (10, 10), (0, 10), (5, 5)], 100), ([(3, 3), (3, 3), (3, 3)], 0), ([(0, 0), (4, 0), (0, 3), (0, 0)], 6)])
def test_hull(spark, points, area):
    arr = F.array(*(F.struct(F.lit(i).alias("slot"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate(points)))
    assert spark.range(1).select(G.hull_area(arr)).first()[0] == pytest.approx(area)


def test_missing_and_divergent_places(spark):
    rows = spark.createDataFrame([(1, 0, 1, 1, 0.0, 0.0, -14105.0, 11671.0), (1, 0, 1, 2, 500.0, 500.0, -14105.0, 11671.0), (1, 0, 1, 3, float("nan"), 4.0, 0.0, 0.0)], POS)
    got = {r.slot: r for r in clean.clean_positions(rows).collect()}
    assert got[1].x is None and got[2].x == 500 and got[3].x is None and got[1].ball_x is None


def test_gaps(spark):
    line = lambda gaps: [None if t in gaps else (10.0 * t, 5.0) for t in range(30)]
    rows = positions(spark, [line(range(5, 10)), line(range(5, 20)), line(range(5, 25)), line(range(0, 3)), line(range(27, 30))])
    got = {s: [r.x for r in sorted((r for r in frames.interpolate_gaps(rows).collect() if r.slot == s), key=lambda r: r.frame_id)] for s in range(1, 6)}
    assert got[1][7] == pytest.approx(70) and got[2][12] == pytest.approx(120)
    assert got[3][12] is None and got[4][1] is None and got[5][28] is None


def test_speeds_and_synchrony(spark):
    fast, slow = [[(20.0 * t + 1, 100.0 + k) for t in range(5)] for k in range(2)], [[(2.0 * t + 1, 300.0 + k) for t in range(5)] for k in range(4)]
    kin = frames.kinematics(frames.slot_velocity(positions(spark, fast + slow)))
    last = [r for r in kin.collect() if r.frame_id == 4][0]
    assert (last.speed_top2, last.speed_bot4, last.speed_diff) == pytest.approx((20, 2, 18))
    assert last.sync_inst == pytest.approx(1)
    apart = positions(spark, [[(10.0 * t, 1.0) for t in range(3)], [(-10.0 * t + 500, 1.0) for t in range(3)]])
    assert one(frames.sync_score(frames.kinematics(frames.slot_velocity(apart))))["sync_score"] == pytest.approx(-1)


def test_activity_gate(spark):
    still, moving = [[(100.0 * k + 1, 200.0)] * 29 for k in range(6)], [[(100.0 * k + 8 * t + 1, 200.0) for t in range(29)] for k in range(6)]
    gate = lambda paths: one(frames.activity_gate(frames.slot_velocity(positions(spark, paths))))["dead_ball"]
    assert gate(still) and not gate(moving) and gate(moving[:1] + [[None] * 29] * 5)


def test_identity_swap(spark):
    a, b = [(100.0 + 5 * t, 100.0) for t in range(10)], [(800.0 + 5 * t, 100.0) for t in range(10)]
    paths = [[a[t] if t % 2 == 0 else b[t] for t in range(10)], [b[t] if t % 2 == 0 else a[t] for t in range(10)]] + [[None] * 10] * 4
    rows = identity.recover_identity(positions(spark, paths))
    steps = [r.speed for r in frames.slot_velocity(rows.withColumns({"ball_x": F.lit(None), "ball_y": F.lit(None)})).collect() if r.speed is not None]
    assert len(steps) == 18 and max(steps) < 50


def test_links_are_least():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for _ in range(40):
        had, has = rng.random(6) < 0.7, rng.random(6) < 0.7
        cost = np.where(had[:, None] & has[None], rng.random((6, 6)), np.inf)
        pairs = [(r, c) for r, c in enumerate(identity.least_links(cost[None])[0]) if np.isfinite(cost[r, c])]
        rows, columns = np.flatnonzero(had), np.flatnonzero(has)
        small, big, m = (rows, columns, cost) if len(rows) <= len(columns) else (columns, rows, cost.T)
        assert len(pairs) == len(small)
        assert sum(cost[r, c] for r, c in pairs) == pytest.approx(min(sum(m[i, j] for i, j in zip(small, k)) for k in permutations(big, len(small))))


def test_identity_of_many_clips(spark):
    rng = np.random.default_rng(5)
    rows = []
    for clip in range(40):
        at = rng.random((6, 2)) * 800
        for t in range(1, 8 + clip % 3):
            at = at + rng.normal(0, 60, (6, 2))
            for slot, p in enumerate(rng.permutation(at), 1):
                rows.append((clip, t, slot, *(map(float, p) if rng.random() < 0.8 else (None, None))))
    df = spark.createDataFrame(rows, "clip int, frame_id long, slot int, x double, y double")
    got = {(r.clip, r.frame_id, r.slot): (r.x, r.y) for r in identity.recover_identity(df, 150.0, ("clip",)).collect()}
    assert len(got) == len(rows)
    for clip in range(40):
        before = None
        for t in range(1, 8 + clip % 3):
            now = [r[3:] for r in rows if r[:2] == (clip, t) and r[3] is not None]
            after = [got[clip, t, s] for s in range(1, 7)]
            assert sorted(p for p in after if p[0] is not None) == sorted(now)
            if before:
                d = np.array([[np.hypot(p[0] - q[0], p[1] - q[1]) if p[0] is not None else np.inf for q in now] + [np.inf] * (6 - len(now)) for p in before])
                left, free = set(range(len(now))), []
                for s, c in enumerate(identity.least_links(d[None])[0]):
                    if d[s, c] <= 150:
                        assert after[s] == now[c]
                        left.discard(c)
                    else:
                        free.append(s)
                assert [after[s] for s in free] == [now[c] for c in sorted(left)] + [(None, None)] * (len(free) - len(left))
            before = after


def _slots_frame_by_frame(rows, max_gap=15, n_slots=6):
    """Slots from the rules, with everything looked at in every frame: rows (frame, id, x, y) to {(frame, id): slot}."""
    out, held = {}, {}  # slot -> (id, last frame, x, y)
    for frame in range(min(r[0] for r in rows), max(r[0] for r in rows) + 1):
        here = {r[1]: r[2:] for r in rows if r[0] == frame and np.isfinite(r[2:]).all()}
        got = {i: s for s, (i, *_) in held.items() if i in here}
        held = {s: h for s, h in held.items() if h[0] in here or frame - h[1] <= max_gap}
        new = [i for i in here if i not in got]
        pairs = sorted((float(np.hypot(here[i][0] - x, here[i][1] - y)), i, s, frame - f) for i in new for s, (o, f, x, y) in held.items() if o not in here)
        for d, i, s, age in pairs:
            if i not in got and s not in got.values() and d <= min(60 * age, 250):
                got[i] = s
        for i in sorted(new):
            free = [s for s in range(n_slots) if s not in held and s not in got.values()]
            if i not in got and free:
                got[i] = free[0]
        for i, s in got.items():
            held[s] = (i, frame, *here[i])
            out[frame, i] = s + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_slots_against_every_frame(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(9):
        at = rng.random(2) * 500
        for f in range(120 + 60 * (seed % 2)):
            at = at + rng.normal(0, 20, 2)
            if rng.random() < 0.9 and (f // 12 + i) % 3 and not 60 < f < 60 + 8 * seed:
                rows.append((f, i + 100 * (f // 50), *(float(v) for v in at)))
    rows.append((3, 77, float("nan"), 1.0))
    want = _slots_frame_by_frame(rows, 5)
    got = identity.manage_slots(spark.createDataFrame([(1, *r) for r in rows], "video_id int, frame int, track_id long, x double, y double"), 5)
    assert {(r.frame, r.track_id): r.slot for r in got.collect()} == want and len(want) < len(rows)


def test_slots_bridge_gaps():
    frame, track = np.array([0, 0, *range(1, 6), 6, 6]), np.array([7, 8, *[8] * 5, 9, 8])
    x = np.where(track == 8, 900.0, np.where(track == 7, 100.0, 132.0))
    assert identity.stretch_slots(frame, track, x, np.full(9, 100.0)).tolist() == [1, 2, 2, 2, 2, 2, 2, 1, 2]
    assert identity.stretch_slots(np.array([0, 1]), np.array([1, 2]), np.array([0.0, 1000.0]), np.zeros(2)).tolist() == [1, 2]
    assert sorted(identity.stretch_slots(np.zeros(7, int), np.arange(7), 100.0 * np.arange(7), np.zeros(7)).tolist()) == [0, 1, 2, 3, 4, 5, 6]


def test_ball_prediction(spark):
    rng = np.random.default_rng(2)
    seen = [None, 0.0, 10.0, *[None] * 14, 40.0, *[float(v) if rng.random() < 0.6 else None for v in rng.random(60) * 100]]
    rows = [(1, t, v, None if v is None else 2 * v) for t, v in enumerate(seen)]
    got = {r.frame: r for r in identity.track_ball(spark.createDataFrame(rows, "video_id int, frame int, ball_x double, ball_y double")).collect()}
    at, velocity, missed = None, 0.0, 0
    for t, v in enumerate(seen):  # step by step
        if v is not None:
            velocity = 0.55 * (v - at) + 0.45 * velocity if at is not None else 0.0
            at, missed = v, 0
        else:
            missed += 1
            at = at + velocity if at is not None and missed <= 12 else at
        lost = at is None or missed > 12
        assert got[t].predicted == (missed > 0 and not lost)
        assert got[t].ball_x is None if lost else got[t].ball_x == pytest.approx(at)
        assert got[t].ball_y is None if lost else got[t].ball_y == pytest.approx(2 * at)


def test_rules(spark):
    n = 12
    spread = positions(spark, [[(700.0 * k + 1, 1.0)] * n for k in range(6)])
    raw = spread.withColumns({"ball_x": F.lit(0.0), "ball_y": F.lit(0.0)})
    assert one(rules.spacing_rule(raw))["spacing"] and not one(rules.attack_rule(raw))["attack"] and not one(rules.delayed_rule(raw))["delayed"]
    drift = positions(spark, [[(150.0 * k + 5 * t + 1, 300.0) for t in range(n)] for k in range(6)]).withColumns({"ball_x": F.lit(0.0), "ball_y": F.lit(0.0)})
    assert one(rules.defense_rule(drift))["defense"] and one(rules.label_clips(drift))["label"] == "Coordinated Defense"
    rush = positions(spark, [[(150.0 * k + (15 if k < 2 else 1) * t + 1, 300.0) for t in range(n)] for k in range(6)]).withColumns({"ball_x": F.lit(500.0), "ball_y": F.lit(400.0)})
    assert one(rules.label_clips(rush))["label"] == "Coordinated Attack"


def test_scalars(spark):
    pick = lambda c: spark.range(1).select(c).first()[0]
    probs = lambda *p: F.array(*(F.lit(float(x)) for x in p))
    assert pick(S.entropy_bits(probs(1, 0, 0))) == 0 and pick(S.entropy_bits(probs(*[0.2] * 5))) == pytest.approx(math.log2(5))
    names = F.array(*(F.lit(x) for x in "ABCD"))
    assert pick(S.confidence_label(probs(0.1, 0.2, 0.3, 0.4), names)) == "Uncertain" and pick(S.confidence_label(probs(0.05, 0.05, 0.1, 0.8), names)) == "D"
    for name, key in (("Coordinated_Attack__videoplayback (1)_clip_002.csv", "(1)"), ("Delayed_Support__videoplayback_clip_306.csv", "(plain)"), ("x.csv", "?")):
        assert pick(S.video_key(F.lit(name))) == key
    assert pick(S.hms_to_seconds(F.lit("00:01:02.5"))) == 62.5 and pick(S.hms_to_seconds(F.lit("nope"))) is None
    assert pick(S.seconds_to_hms(F.lit(-3.0))) == "00:00:00.000"
    assert pick(S.frame_number(F.lit("a7_frame-0012"))) == 12 and pick(S.frame_number(F.lit("none"))) is None
    assert pick(G.foot_point(*(F.lit(float(v)) for v in (100, 200, 140, 360)))).asDict() == {"x": 120.0, "y": 360.0}


def test_class_weights(spark):
    rows = spark.createDataFrame([(c,) for c, n in (("A", 42), ("B", 23), ("C", 82), ("D", 101)) for _ in range(n)], "label string")
    got = {r.label: r.weight for r in scores.class_weights(rows, "ABCDE").collect()}
    assert got["E"] == 0 and sum(got.values()) / 4 == pytest.approx(1) and max(got, key=got.get) == "B"


def test_scores_of_perfect_predictions(spark):
    rows = spark.createDataFrame([("A", "A"), ("B", "B"), ("B", "B")], "y_true string, y_pred string")
    got = one(scores.classification_scores(rows))
    assert all(got[k] == pytest.approx(1) for k in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "cohen_kappa"))


def test_blocks_and_quarantine(spark):
    rows = spark.createDataFrame([(1, i) for i in range(100)], "v long, frame_id long")
    split = {r.frame_id: r for r in events.temporal_split(rows, ("v",)).collect()}
    again = {r.frame_id: r.split for r in events.temporal_split(rows.orderBy(F.desc("frame_id")), ("v",)).collect()}
    assert again == {k: r.split for k, r in split.items()} and len({r.block for r in split.values() if r.split == "val"}) == 2
    ten = spark.createDataFrame([(1, i, i, i in (4, 5)) for i in range(10)], "v long, frame_id long, pos long, is_val boolean")
    assert [r.frame_id for r in events.quarantine(ten, ("v",)).where("split = 'gap'").orderBy("frame_id").collect()] == [3, 6]


def test_preflight(spark):
    stats = spark.createDataFrame([("blind", 0.0, 0.0, 0.0, 0.5), ("masked", 12.0, 0.0, 0.0, 0.5), ("split", 12.0, 10.0, 0.0, 0.5), ("fine", 12.0, 10.0, 6.0, 0.5), ("ball", 12.0, 10.0, 6.0, 0.1)], "name string, raw_person_median double, masked_person_median double, team_person_median double, ball_recall double")
    got = {(r.name, r.level, r.stage) for r in teams.preflight_verdict(stats).collect()}
    assert got == {("blind", "FATAL", "detection"), ("masked", "FATAL", "court mask"), ("split", "FATAL", "team split"), ("ball", "WARN", "ball")}
    with pytest.raises(ValueError):
        teams.require(teams.preflight_verdict(stats))


def test_novelty(spark):
    rng = np.random.default_rng(0)
    rows = [(*map(float, rng.normal(0, 1, 3)), "Coordinated Attack") for _ in range(60)] + [(*map(float, rng.normal(8, 1, 3)), "Delayed Support") for _ in range(10)]
    got = teams.tactical_deviation(spark.createDataFrame(rows, "a double, b double, c double, label string"), ("a", "b", "c")).groupBy("label").agg(F.avg("deviation").alias("d"))
    mean = {r.label: r.d for r in got.collect()}
    assert mean["Delayed Support"] > 3 * mean["Coordinated Attack"]


def test_roles(spark):
    n, net = 29, 450.0
    attacker = [(300.0, net + 400 - 13 * t) for t in range(n)]
    setter = [(900.0, net + 50)] * n
    libero = [(200.0 + 12 * t, net + 400) for t in range(n)]
    defender = [(1200.0, net + 380)] * n
    got = roles.infer_roles(frames.slot_velocity(positions(spark, [attacker, setter, libero, defender, [None] * n, [None] * n])))
    assert {r.slot: r.role for r in got.collect()} == {1: "attacker", 2: "setter", 3: "libero", 4: "defender", 5: "unknown", 6: "unknown"}


def test_knn_and_thinning(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.random(4)], i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.query_id, r["rank"]): r.vec_id for r in neighbours.knn(df.where("vec_id < 5"), df, 3).collect()}
    m = np.array([r[1] for r in rows], np.float32).astype(float)
    for q in range(5):
        d = ((m - m[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [got[q, k + 1] for k in range(3)] == np.argsort(d)[:3].tolist()
    line = spark.createDataFrame([(0, t, [0.1 * t]) for t in range(10)], "k long, t long, s array<double>")
    assert [r.t for r in thinning.diverse_thin(line, "k", "t", "s", 0.25).orderBy("t").collect()] == [0, 3, 6, 9]


def test_pose(spark):
    from courtline.operators import pose

    def body(t, hip_y, angle, conf=0.9):
        kp = [(0.0, 0.0, 0.0)] * 17
        kp[5] = kp[6] = (100.0, 100.0, conf)
        kp[9] = kp[10] = (100 + 50 * math.cos(angle), 100 + 50 * math.sin(angle), conf)
        kp[11] = kp[12] = (100.0, hip_y, conf)
        return (1, t, 3, (0.0, 0.0, 50.0, 185.0), kp)

    heights, angles = [100.0, 100.0, 80.0, 60.0, 60.0, 60.0], [0.0, 0.0, 3.0, -3.0, -3.0, -3.0]
    rows = [body(t, h, a) for t, (h, a) in enumerate(zip(heights, angles, strict=True))] + [body(6, 0.0, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "video_id long, frame long, track_id long, box struct<x1:double,y1:double,x2:double,y2:double>, kp array<struct<x:double,y:double,conf:double>>")
    got = {r.frame: r for r in pose.pose_motion(df).collect()}
    ema, want = 0.0, [0.0]
    for a, b in zip(heights, heights[1:], strict=False):
        ema = 0.5 * -(b - a) * (1.85 / 185) * 30 + 0.5 * ema
        want.append(ema)
    assert [got[t].vy_ms for t in range(6)] == pytest.approx(want) and got[6].vy_ms == 0
    assert got[3].arm_omega_rad_s == pytest.approx((2 * math.pi - 6) * 30) and got[2].impact and not got[4].impact
    assert [t for t in got if got[t].takeoff] == [2]


def test_court_mask_and_homography(spark):
    from courtline.operators import court

    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    quad = F.array(point(100, 100), point(1180, 100), point(1180, 620), point(100, 620))
    at = lambda x, y: spark.range(1).select(G.quad_signed_distance(F.lit(float(x)), F.lit(float(y)), quad)).first()[0]
    assert at(530, 500) == pytest.approx(120) and at(35, 90) == pytest.approx(-math.hypot(65, 10)) and at(100, 300) == pytest.approx(0)
    cal = spark.range(1).select(F.lit(1).alias("video_id"), F.reverse(quad).alias("corners"), F.lit(False).alias("half"))
    h = court.homography_fit(cal)
    for (x, y), want in (((100, 100), (0, 0)), ((1180, 620), (1800, 900)), ((640, 360), (900, 450))):
        got = h.select(G.apply_homography(F.col("h"), F.lit(float(x)), F.lit(float(y))).alias("p")).first().p
        assert (got.x, got.y) == pytest.approx(want)
    feet = spark.createDataFrame([(1, 1, 1, 510.0, 400.0, 550.0, 500.0), (1, 1, 2, 15.0, 40.0, 55.0, 90.0), (2, 1, 3, 15.0, 40.0, 55.0, 90.0)], "video_id int, frame long, det_id int, x1 double, y1 double, x2 double, y2 double")
    assert {r.det_id for r in court.court_mask(feet, cal).collect()} == {1, 3}


def test_padding(spark):
    from courtline.operators import clips

    short = spark.createDataFrame([(1, 0, t, 5.0) for t in range(10, 27)], "match_id long, sequence long, frame_id long, v double")
    got = clips.pad_windows(short).orderBy("t").collect()
    assert len(got) == 29 and [r.v for r in got] == [5.0] * 17 + [0.0] * 12


@pytest.mark.parametrize("forget", [True, False])
def test_votes_of_long_tracks(spark, forget):
    rng = np.random.default_rng(0)
    frame = np.sort(rng.choice(120_000, 100_000, replace=False)) if not forget else np.arange(100_000)
    team = rng.choice(["NEAR", "FAR", "UNKNOWN"], 100_000)
    got = teams.team_votes(spark.createDataFrame([(1, int(f), 4, str(t)) for f, t in zip(frame, team)], "video_id int, frame long, track_id int, team string"), forget=forget).toPandas().sort_values("frame")
    near, before, want = 0.0, 0, []
    for f, t in zip(frame.tolist(), team):
        near = near * 0.98 ** (f - before) + (t == "NEAR")
        before = f
        want.append(near)
    assert np.allclose(got["near"], want, rtol=1e-9) and np.isfinite(got["far"]).all()
