"""The registered out-of-fold queries leave out one match, or one of five folds, at a time."""

from pyspark.sql import functions as F

from courtline.plans import learning as plans


def _clips(spark, sf_dir):
    rows = [(m, q, f"{m}_{q}", "a" if q % 2 else "b", *(float(q % 2 + 0.1 * ((m + i) % 3)) for i in range(len(plans._METRICS)))) for m in range(6) for q in range(4)]
    return spark.createDataFrame(rows, ["match_id", "sequence", "clip", "label", *plans._METRICS])


def test_folds_are_matches_and_fifths(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(plans.learning, "grouped_predictions", lambda rows, names, fold, model="logistic": seen.append((fold, model)) or rows.withColumn("y_true", F.col("label")).withColumn("y_pred", F.col("label")))
    monkeypatch.setattr(plans.frames, "window_metrics", lambda *a: _clips(spark, sf_dir).drop("label"))
    monkeypatch.setattr(plans.rules, "label_clips", lambda *a: _clips(spark, sf_dir))
    monkeypatch.setattr(plans, "frame_channels", lambda *a: None)
    monkeypatch.setattr(plans.X, "raw_positions", lambda *a: None)
    lovo = plans.QUERIES["ml5_lovo_predict"](spark, sf_dir)
    assert sorted(r.video for r in lovo.select("video").distinct().collect()) == list(range(6))
    folds = plans.QUERIES["ml4_kfold_predict"](spark, sf_dir)
    assert folds.count() == 24 and sorted(r.fold for r in folds.select("fold").distinct().collect()) == list(range(5))
    assert seen == [("video", "tree"), ("fold", "tree")]
