"""Scores of predictions: confusion matrix, per-class reports, baselines and weights.

predictions: y_true, y_pred (label names). Everything follows from one small table of counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import TACTICS


def counts(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(pred: DataFrame, classes: Sequence[str] = TACTICS) -> DataFrame:
    """One row per true class, one column per predicted class, all classes listed; and the recall."""
    cells = [F.coalesce(F.sum(F.when(F.col("y_pred") == c, F.col("n"))), F.lit(0)).alias(c.lower().replace(" ", "_")) for c in classes]
    every = pred.sparkSession.createDataFrame([(c,) for c in classes], "y_true string")
    rows = every.join(F.broadcast(counts(pred)), "y_true", "left").groupBy("y_true").agg(*cells, F.coalesce(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))), F.lit(0)).alias("hit"), F.coalesce(F.sum("n"), F.lit(0)).alias("support"))
    return rows.withColumn("recall", F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)).drop("hit")


def per_class(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """hit, support, predicted, precision, recall and f1 of each label that is true or predicted somewhere."""
    c = counts(pred, keys)
    cell = c.select(*keys, F.inline(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))))
    out = cell.groupBy(*keys, "label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("hit") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return out.select(*keys, "label", "support", "predicted", "hit", share("hit", "predicted").alias("precision"), share("hit", "support").alias("recall"), f1.alias("f1"))


def classification_scores(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy (labels that are true somewhere), macro and weighted F1 (labels true or predicted) and Cohen's kappa."""
    n, agree, chance = F.sum("support"), F.sum("hit"), F.sum(F.col("support") * F.col("predicted"))
    expected = chance / (n * n)
    kappa = F.when(expected < 1, (agree / n - expected) / (1 - expected)).otherwise(0.0)
    return per_class(pred, keys).groupBy(*keys).agg((agree / n).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), kappa.alias("cohen_kappa"), n.alias("n"))


def fixed_class_scores(pred: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Accuracy, macro F1 and balanced accuracy averaged over all given classes, absent ones as 0."""
    k = len(classes)
    own = per_class(pred)
    return own.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), (F.sum(F.when(F.col("label").isin(*classes), F.col("f1"))) / k).alias("macro_f1"), (F.sum(F.when(F.col("label").isin(*classes), F.col("recall"))) / k).alias("balanced_acc"))


def class_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label, with a macro and a weighted row."""
    own = per_class(pred).select("label", "precision", "recall", "f1", "support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    macro = own.agg(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    total = own.agg(F.lit("weighted avg").alias("label"), *(weighted(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    return own.unionByName(macro).unionByName(total)


def majority_baseline(pred: DataFrame) -> DataFrame:
    """Scores of always predicting the most frequent true label (the first by name on ties)."""
    totals = pred.groupBy("y_true").agg(F.count("*").alias("n"))
    mode = totals.orderBy(F.desc("n"), "y_true").limit(1).select(F.col("y_true").alias("y_pred"))
    return classification_scores(pred.select("y_true").join(F.broadcast(mode)))


def class_weights(labels: DataFrame, classes: Sequence[str], cap: float = 4.0) -> DataFrame:
    """Inverse counts with mean 1 over the classes that occur, at most ``cap``; exactly 0 for those that don't."""
    every = labels.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    rows = every.join(F.broadcast(labels.groupBy("label").agg(F.count("*").alias("n"))), "label", "left")
    inverse = 1 / F.col("n")
    return rows.withColumn("weight", F.when(F.col("n") > 0, F.least(F.lit(cap), inverse / F.avg(inverse).over(W.partitionBy()))).otherwise(0.0)).select("label", F.coalesce("n", F.lit(0)).alias("n"), "weight")


def balanced_weights(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n / (K * n_k) of each class within its fold."""
    w = W.partitionBy(*keys)
    own = labels.groupBy(*keys, "label").agg(F.count("*").alias("n_k"))
    return own.select(*keys, "label", "n_k", (F.sum("n_k").over(w) / (F.count("*").over(w) * F.col("n_k"))).alias("weight"))


def norm_stats(chan: DataFrame) -> DataFrame:
    """Mean and sample standard deviation (at least 1e-6) of each channel over all rows."""
    return chan.groupBy("channel").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_samp("v"), F.lit(1e-6)).alias("std"))


def best_epoch(history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row of the highest macro F1; the last one on ties."""
    return history.groupBy(*keys).agg(F.max_by("epoch", F.struct("macro_f1", "epoch")).alias("best_epoch"), F.max("macro_f1").alias("best_macro_f1"))


def model_ranking(scores: DataFrame, metric: str = "macro_f1") -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(W.orderBy(F.desc(metric), "model")))


def ablation_table(scores: DataFrame, base: str) -> DataFrame:
    """Best model of each mode and what it gains over the best model of ``base``."""
    best = scores.groupBy("mode").agg(F.min_by("model", F.struct(-F.col("macro_f1"), "model")).alias("model"), F.max("macro_f1").alias("macro_f1"))
    ref = best.where(F.col("mode") == base).select(F.col("macro_f1").alias("base_f1"))
    return best.join(F.broadcast(ref)).select("mode", "model", "macro_f1", (F.col("macro_f1") - F.col("base_f1")).alias("gain"))


def gold_latest(gold: DataFrame) -> DataFrame:
    """Newest label of each clip."""
    return gold.withColumn("k", F.row_number().over(W.partitionBy("clip").orderBy(F.desc("labelled_at"), "annotator"))).where("k = 1").drop("k")


def label_todo(sample: DataFrame, gold: DataFrame) -> DataFrame:
    return sample.join(gold.select("clip").distinct(), "clip", "left_anti")


def salted_hash(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def balanced_sample(rows: DataFrame, per_label: int, seed: int = 7) -> DataFrame:
    """``per_label`` rows of each label, chosen by a seeded hash of ``clip``; place is a shuffled order over all."""
    first = W.partitionBy("label").orderBy(salted_hash(F.col("clip"), seed), "clip")
    picked = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_label).drop("k")
    return picked.withColumn("place", F.row_number().over(W.orderBy(salted_hash(F.col("clip"), seed + 1), "clip")))


def stratified_split(rows: DataFrame, test: float = 0.15, val: float = 0.15, seed: int = 7) -> DataFrame:
    """train, val or test per row: shares of each label cut down, one of each at least from three rows on, train never empty."""
    place = F.row_number().over(W.partitionBy("label").orderBy(salted_hash(F.col("clip"), seed), "clip"))
    n = F.count("*").over(W.partitionBy("label"))
    least = F.when(n >= 3, 1).otherwise(0)
    n_test, n_val = F.greatest(F.floor(n * test), least), F.greatest(F.floor(n * val), least)
    kept = n - n_test - n_val
    n_val = F.when(kept < 1, F.greatest(F.lit(0), n_val - (1 - kept))).otherwise(n_val)
    return rows.withColumn("split", F.when(place <= n_test, "test").when(place <= n_test + n_val, "val").otherwise("train"))


def kfold(rows: DataFrame, k: int = 5, seed: int = 7) -> DataFrame:
    """Fold 0..k-1, stratified by label."""
    return rows.withColumn("fold", (F.row_number().over(W.partitionBy("label").orderBy(salted_hash(F.col("clip"), seed), "clip")) - 1) % k)


def holdout_split(rows: DataFrame, key: str) -> DataFrame:
    """All clips of one video are test, the others train."""
    key = key if key.startswith("(") else f"({key})"
    return rows.withColumn("split", F.when(F.col("video_key") == key, "test").otherwise("train"))
