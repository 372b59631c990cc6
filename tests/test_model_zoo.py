"""Models beyond trees and logistic regression, over folds and as saved bundles."""

import math

import pytest
from pyspark.sql import functions as F

from courtline.operators import learning, models


def _clips(spark, labels="abc"):
    """Labels apart in ``telling``, with a missing value and a column of noise."""
    rows = [(f"c{k}", labels[k % len(labels)], k % 2, None if k == 5 else 3.0 * (k % len(labels)) + 0.01 * (k % 7), float(k // 2 * 7 % 4)) for k in range(48)]  # noise is spread alike over folds
    return spark.createDataFrame(rows, "clip string, label string, fold int, telling double, noise double")


@pytest.mark.parametrize("model", ["gbt", "mlp", "knn"])
def test_folds_of_each_model(spark, model):
    got = learning.grouped_predictions(_clips(spark), ["telling", "noise"], "fold", model).collect()
    assert sorted(r.clip for r in got) == sorted(f"c{k}" for k in range(48))
    assert all(math.isclose(sum(r.probs), 1, abs_tol=1e-9) and min(r.probs) >= 0 and len(r.probs) == 3 for r in got)
    assert all(r.y_pred == "abc"[r.probs.index(max(r.probs))] for r in got)
    right = [r.y_pred == r.y_true for r in got if r.clip != "c5"]  # its missing value is filled with a median
    assert sum(right) >= (0.9 if model == "mlp" else 1) * len(right)


@pytest.mark.parametrize("model", ["gbt", "mlp"])
def test_label_that_a_fold_lacks(spark, model):
    """Label b is in fold 0 alone: what is left out there can't be called b, and nothing fails."""
    rows = _clips(spark, "acc").withColumn("label", F.when((F.col("fold") == 0) & (F.col("noise") < 2), "b").otherwise(F.col("label")))
    got = learning.grouped_predictions(rows, ["telling", "noise"], "fold", model).where("fold = 0").collect()
    assert len(got) == 24 and {r.y_true for r in got} > {"b"} and all(r.y_pred != "b" and math.isclose(sum(r.probs), 1, abs_tol=1e-9) for r in got)


def test_neighbours_against_brute_force(spark):
    rows = _clips(spark).where("clip <> 'c5'")
    got = {r.clip: r for r in learning.grouped_predictions(rows, ["telling", "noise"], "fold", "knn").collect()}
    data = rows.collect()
    for q in data:
        train = [r for r in data if r.fold != q.fold]
        scale = []
        for c in ("telling", "noise"):
            mean = sum(r[c] for r in train) / len(train)
            scale.append(math.sqrt(sum((r[c] - mean) ** 2 for r in train) / (len(train) - 1)))
        far = lambda r: math.sqrt(sum(((r[c] - q[c]) / s) ** 2 for c, s in zip(("telling", "noise"), scale)))  # noqa: B023, E731
        near = sorted(train, key=far)
        if math.isclose(far(near[4]), far(near[5])):
            continue  # a tie at the border goes by id
        weight = {x: sum(1 / max(far(r), 1e-12) for r in near[:5] if r.label == x) for x in "abc"}
        assert got[q.clip].probs == pytest.approx([weight[x] / sum(weight.values()) for x in "abc"], abs=1e-6)


@pytest.mark.parametrize("model", ["gbt", "mlp"])
def test_bundle_of_each_model(spark, tmp_path, model):
    rows = _clips(spark)
    bundle = models.fit_bundle(rows, ["telling", "noise"], model)
    models.save_bundle(spark, bundle, str(tmp_path / "m"))
    again = models.load_bundle(spark, str(tmp_path / "m"), "1")
    key = lambda b: {r.clip: (r.label, r.confidence, r.probs) for r in models.batch_score(rows, b).collect()}
    assert key(bundle) == key(again) and all(math.isclose(sum(p.values()), 1, abs_tol=1e-3) for _, _, p in key(again).values())
