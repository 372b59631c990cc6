"""Thinning by repaired chunks, repeatable noise, class names, long label lines, feature order, replayed streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.operators import clips, measures, thinning
from courtline.sources import files


@pytest.mark.parametrize(("parts", "threshold", "walk"), [(1, 0.5, 0.1), (9, 0.5, 0.1), (9, 0.5, 2.0), (12, 30.0, 0.1), (12, 0.0, 0.1), (7, 3.0, 0.5)])
def test_thinning(spark, parts, threshold, walk):
    rng, rows, want = np.random.default_rng(int(10 * threshold) + parts), [], set()
    for key, n in (("hot", 700), ("b", 90), ("one", 1), ("flat", 150)):
        at, last = np.zeros(5), None
        for o in range(n):
            at = at + (rng.normal(0, walk, 5) if key != "flat" else 0)
            rows.append((key, 3 * o - 60, at.tolist()))
            if last is None or np.abs(at - last).mean() >= threshold:
                want.add((key, 3 * o - 60))
                last = at
    rows += [("b", None, [0.0] * 5), (None, 4, [0.0] * 5), ("b", 10_000, None)]
    df = spark.createDataFrame(rows, "label string, n int, sig array<double>").repartition(4)
    got = thinning.diverse_thin(df, "label", "n", "sig", threshold, parts)
    assert got.columns == ["label", "n"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) and set(got) == want
    assert thinning.diverse_thin(df.where("false"), "label", "n", "sig", threshold, parts).count() == 0


def test_noise_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(m, t // 29, t, s, rng.uniform(0, 1800) if rng.random() < 0.9 else None, 4.0, 700.0, 300.0) for m in range(8) for t in range(1, 90) for s in range(1, 7)]
    df = spark.createDataFrame(rows, "match_id long, sequence long, frame_id long, slot int, x double, y double, ball_x double, ball_y double")
    one, many = (sorted(map(tuple, measures.augment(df.repartition(n)).collect()), key=lambda r: r[:4]) for n in (1, 50))
    assert one == many
    by = {r[:4]: r for r in rows}
    moved = np.array([[(1800 - r[4] if r[8] else r[4]) - by[r[:4]][4], r[5] - by[r[:4]][5]] for r in one if r[4] is not None])
    assert abs(moved.mean()) < 0.6 and np.allclose(moved.std(axis=0), 15, atol=0.7) and abs(np.corrcoef(moved.T)[0, 1]) < 0.05
    assert all((r[4] is None) == (by[r[:4]][4] is None) for r in one)
    coins, balls = {}, {}
    for r in one:
        coins.setdefault(r[:2], set()).add(r[8])
        balls.setdefault((r[0], r[2]), set()).add(r[6:8])
    assert all(len(v) == 1 for v in (*coins.values(), *balls.values())) and {x for v in coins.values() for x in v} == {True, False}


@pytest.mark.parametrize(("names", "want"), [({0: "person", 32: "sports ball"}, (0, 32)), ({0: "ball", 1: "player"}, (1, 0)), ({0: " Athlete ", 1: "net"}, (0, None)), ({3: "thing"}, (3, None)), ({3: "ball"}, (3, 3)), ({0: "ball player", 1: "Human"}, (1, 0)), ({0: "net", 1: "referee"}, (None, None))])
def test_class_names(spark, names, want):
    df = spark.createDataFrame([("m", i, n) for i, n in names.items()], "model string, id long, name string")
    assert tuple(measures.resolve_classes(df).first())[1:] == want
    assert tuple(measures.resolve_classes(df, 7, 8).first())[1:] == (7, 8)


def test_long_label_lines_are_read_whole(spark):
    line = "0 " + " ".join(["0.25"] * 3000)
    df = spark.createDataFrame([(line,), (line + " 7.5 0.5",), ("1 .1 .1 .1 .1",), ("",), (None,)], "value string")
    got = {r.value: (r.kind, len(r.coords or [])) for r in files.parse_label_lines(df).collect()}
    assert got[line] == ("polygon", 3000) and got[line + " 7.5 0.5"] == ("bad", 3002) and got["1 .1 .1 .1 .1"] == ("box", 4)


def test_features_are_in_order(spark):
    assert [len(clips.feature_names(m)) for m in clips.MODES] == [108, 132, 240]
    assert clips.feature_names("both") == clips.feature_names("absolute") + clips.feature_names("invariant")
    with pytest.raises(ValueError, match="unknown feature mode"):
        clips.feature_names("nonsense")
    rng = random.Random(2)
    names = clips.MODEL_CHANNELS
    rows = [(1, c, t, *(rng.uniform(1, 9) for _ in names)) for c in (1, 2) for t in range(29)]
    table = spark.createDataFrame(rows, "match_id long, sequence long, frame_id long, " + ", ".join(f"{n} double" for n in names))
    got = {m: {r.sequence: r.features for r in clips.feature_vector(table, m).collect()} for m in clips.MODES}
    for c in (1, 2):
        assert got["both"][c] == got["absolute"][c] + got["invariant"][c] and len(got["both"][c]) == 240
        v = {ch: np.array([r[3 + i] for r in rows if r[1] == c]) for i, ch in enumerate(names)}
        value = dict(zip(clips.feature_names("absolute"), got["absolute"][c], strict=True))
        assert all(np.isclose(value[f"{ch}__{name}"], f(x)) for ch, x in v.items() for name, f in (("mean", np.mean), ("std", np.std), ("min", np.min), ("max", np.max)))
        z = dict(zip(clips.feature_names("invariant"), got["invariant"][c], strict=True))
        assert all(np.isclose(z[f"{ch}__z_max"], (x.max() - x.mean()) / x.std()) for ch, x in v.items())
        ratio = np.clip(v["nn_dist_min"] / (np.abs(v["nn_dist_mean"]) + 1e-6), -50, 50)
        assert np.isclose(z["tightest_pair__mean"], ratio.mean()) and np.isclose(z["n_present__mean"], v["n_present"].mean())
