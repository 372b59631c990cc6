"""Colours, skeletons, label checks and models: small closed cases, brute force, SQL twins."""

import math
import warnings

import duckdb
import pytest

from courtline.operators import colours, models, pose
from courtline.plans import colours as plans
from courtline.sources import files

BOX = "video_id long, frame long, det_id int, x1 double, y1 double, x2 double, y2 double, y double"
TABLES = ("lineitem", "orders", "customer")


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = plans.QUERIES[name](spark, sf_dir)
    assert set(got.columns) == set(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_torso_is_a_median_inside_the_box(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 40.0, 100.0, 500.0), (1, 1, 2, 0.0, 0.0, 1.0, 90.0, 500.0)], BOX)
    inside = [(1, 1, 1, 20, 30, 45.0, 255.0, 51.0), (1, 1, 1, 21, 30, 45.0, 255.0, 51.0), (1, 1, 1, 22, 30, 170.0, 0.0, 255.0)]
    pixels = spark.createDataFrame([*inside, (1, 1, 1, 30, 30, 0.0, 0.0, 0.0), (1, 1, 1, 20, 50, 0.0, 0.0, 0.0), (1, 1, 2, 0, 30, 9.0, 9.0, 9.0)], "video_id long, frame long, det_id int, px int, py int, h double, s double, v double")
    got = {r.det_id: (r.cx, r.cy, r.cv) for r in colours.torso_colours(boxes, pixels).collect()}
    assert got[1] == pytest.approx((0.0, 1.0, 0.2), abs=1e-12) and got[2] == (0.0, 0.0, 0.0)


def _two_teams(spark, ys):
    rows = [(1, f, k, k, ys[k % 2], 0.9 if k % 2 else -0.9, 0.01 * f, 0.5) for f in range(1, 61) for k in range(4)]
    return spark.createDataFrame(rows, "video_id long, frame long, det_id int, track_id long, y double, cx double, cy double, cv double")


def test_colour_decides_after_the_warm_up(spark):
    swapped = 50  # from here on everybody stands in the other half
    rows = _two_teams(spark, (700.0, 200.0)).selectExpr("video_id", "frame", "det_id", "track_id", f"CASE WHEN frame >= {swapped} THEN 900 - y ELSE y END AS y", "cx", "cy", "cv")
    for r in colours.video_teams(rows).collect():
        by_shirt = "FAR" if r.det_id % 2 else "NEAR"
        assert r.by_colour == (r.frame > 45)
        assert r.team == by_shirt
    assert colours.warmup_samples(rows).count() == 45 * 4
    assert colours.warmup_samples(rows.where("frame < 45")).count() == 0


def test_one_sided_fit_is_left_to_the_court(spark):
    fitted = colours.fit_teams(_two_teams(spark, (700.0, 650.0)))
    assert fitted.where("degenerate").count() == fitted.count() > 1
    assert {r.team for r in colours.video_teams(_two_teams(spark, (700.0, 650.0))).collect()} == {"NEAR"}
    assert colours.fit_teams(_two_teams(spark, (700.0, 200.0)).limit(0)).count() == 0


def test_clip_keeps_one_team(spark):
    rows = _two_teams(spark, (700.0, 200.0)).selectExpr("*", "CAST(floor((frame - 1) / 30) AS LONG) AS clip")
    got = colours.clip_team_select(rows, "FAR")
    assert got.count() == 120 and {r.det_id for r in got.select("det_id").distinct().collect()} == {1, 3}


def _greedy(a, b, least=0.3):
    def iou(p, q):
        w, h = (max(0.0, min(p[k + 2], q[k + 2]) - max(p[k], q[k])) for k in (0, 1))
        area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        return w * h / (area(p) + area(q) - w * h + 1e-9)

    found, out = sorted(((iou(p, q), i, j) for i, p in a.items() for j, q in b.items()), reverse=True), []
    for v, i, j in found:
        if v >= least and i not in {x[0] for x in out} and j not in {x[1] for x in out}:
            out.append((i, j))
    return out


def test_skeletons_best_first(spark, sf_dir):
    tracks = plans._people(spark, sf_dir).where("video_id < 5")
    skeletons = plans._skeletons(spark, sf_dir).where("video_id < 5")
    got, a, b = {}, {}, {}
    for r in pose.match_skeletons(tracks, skeletons).collect():
        got.setdefault((r.video_id, r.frame), set()).add((r.track_id, r.skeleton_id))
    for out, rows, key in ((a, tracks, "track_id"), (b, skeletons, "skeleton_id")):
        for r in rows.collect():
            out.setdefault((r.video_id, r.frame), {})[r[key]] = (r.x1, r.y1, r.x2, r.y2)
    want = {k: set(_greedy(v, b[k])) for k, v in a.items()}
    assert got == {k: v for k, v in want.items() if v} and got


def test_one_track_takes_one_skeleton(spark):
    kind = "video_id long, frame long, {} long, x1 double, y1 double, x2 double, y2 double"
    a = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 1.0, 0.0, 11.0, 10.0)], kind.format("track_id"))
    b = spark.createDataFrame([(1, 1, 7, 1.0, 0.0, 11.0, 10.0), (1, 1, 8, 40.0, 0.0, 50.0, 10.0)], kind.format("skeleton_id"))
    assert [tuple(r)[:4] for r in pose.match_skeletons(a, b).collect()] == [(1, 1, 2, 7)]


def test_label_faults(spark):
    values = ["", "0 .5 .5 .1 .1", "0 .5 .5 .1", "a .5 .5 .1 .1", "2 .5 .5 .1 .1", "0 .5 .5 .1 1.01", "0 .5 .5 .1 0", "-0.5 .5 .5 .1 .1"]
    lines = spark.createDataFrame([("val", "s", k, v) for k, v in enumerate(values)], "split string, stem string, line int, value string")
    faults = files.verify_labels(lines, lines, 2)
    assert sorted((r.line, r.problem) for r in faults.collect()) == [(2, "number of coordinates"), (3, "not a number"), (4, "class out of range"), (5, "coordinate out of range"), (6, "no width or height")]
    assert [tuple(r) for r in files.label_verdict(faults, lines).select("split", "n_faults", "verdict").collect()] == [("val", 5, "FAIL")]
    assert files.label_verdict(faults.limit(0), lines).first().verdict == "PASS"


def _clips(spark):
    rows = [(f"c{k}", "a" if k % 2 else "b", k % 3, float(k % 2) + 0.01 * (k % 5), float((k * 7) % 4)) for k in range(36)]
    return spark.createDataFrame(rows, "clip string, label string, video long, telling double, noise double")


def test_importance_finds_the_channel(spark):
    got = models.channel_importance(_clips(spark), {"telling": ["telling"], "noise": ["noise"]}, "video").collect()
    assert [r.channel for r in got] == ["telling", "noise"] and got[0].importance_mean > 0.2 and abs(got[1].importance_mean) < 1e-9 and got[1].importance_std < 1e-9
    assert models.channel_importance(_clips(spark), {"telling": ["telling"], "noise": ["noise"]}, "video", top=1).count() == 1


def test_calibrated_probabilities_sum_to_one(spark):
    got = models.calibrate(_clips(spark), ["telling", "noise"]).collect()
    assert len(got) == 36 and all(math.isclose(sum(r.calibrated), 1, abs_tol=1e-9) and r.y_pred == r.y_true and r.folds == 5 for r in got)
    one = _clips(spark).where("label = 'a' or clip = 'c0'")
    assert {r.folds for r in models.calibrate(one, ["telling", "noise"]).collect()} <= {0}


def test_bundle_round_trip(spark, tmp_path):
    bundle = models.fit_bundle(_clips(spark), ["telling", "noise"], "tree", version="3")
    models.save_bundle(spark, bundle, str(tmp_path / "m"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        again = models.load_bundle(spark, str(tmp_path / "m"), "3")
    assert again[1:] == bundle[1:]
    want = {r.clip: r.label for r in _clips(spark).collect()}
    for r in models.batch_score(_clips(spark), again).collect():
        assert r.label == want[r.clip] and math.isclose(sum(r.probs.values()), 1, abs_tol=1e-3) and r.is_anomaly == (r.confidence < 0.5) and 0 <= r.entropy_norm <= 1
    with pytest.warns(UserWarning):
        models.load_bundle(spark, str(tmp_path / "m"), "4")
    with pytest.raises(ValueError):
        models.batch_score(_clips(spark).drop("noise"), again)
