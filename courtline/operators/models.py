"""Fitted models beyond their scores: importance of channels, calibration, bundles and scoring of new rows."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import entropy_bits, entropy_norm
from .learning import PARALLEL, against_rest, class_probabilities, grouped_predictions, model_pipeline
from .scores import balanced_weights, classification_scores, kfold
from .stored import stored


class Bundle(NamedTuple):
    """A fitted pipeline with what its scores mean."""

    model: Any
    labels: list[str]
    names: list[str]
    mode: str
    version: str


def fit_bundle(rows: DataFrame, names: Sequence[str], model: str = "logistic", mode: str = "metrics", version: str = "1") -> Bundle:
    """The model of ``names`` fitted on all rows (label and features), classes weighted inversely to their size."""
    labels = [r[0] for r in rows.select("label").where("label is not null").distinct().orderBy("label").collect()]
    ids = F.create_map(*(F.lit(x) for k, v in enumerate(labels) for x in (v, float(k))))
    weighted = rows.select("label", *names).join(F.broadcast(balanced_weights(rows).select("label", "weight")), "label")
    weighted = against_rest(weighted.withColumn("label_id", ids[F.col("label")]), len(labels))
    return Bundle(model_pipeline(names, model, len(labels)).fit(weighted), labels, list(names), mode, version)


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """The pipeline and one line of JSON beside it; an existing bundle is never written over."""
    bundle.model.save(f"{path}/pipeline")
    about = json.dumps({"labels": bundle.labels, "names": bundle.names, "mode": bundle.mode, "version": bundle.version})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")


def load_bundle(spark: SparkSession, path: str, version: str | None = None) -> Bundle:
    """The bundle at ``path``; a warning if its features are of another version than the caller's."""
    from pyspark.ml import PipelineModel

    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if version is not None and about["version"] != version:
        warnings.warn(f"{path} was fitted on features of version {about['version']}, not {version}", stacklevel=2)
    return Bundle(PipelineModel.load(f"{path}/pipeline"), about["labels"], about["names"], about["mode"], about["version"])


def batch_score(rows: DataFrame, bundle: Bundle, least: float = 0.5) -> DataFrame:
    """Adds label, confidence, entropy, entropy_norm, is_anomaly (confidence under ``least``) and probs (label to probability)."""
    if missing := set(bundle.names) - set(rows.columns):
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    own = [c for c in rows.columns if c not in ("label", "weight", "label_id")]
    got = bundle.model.transform(rows.select(*own))
    got = got.select(*own, class_probabilities(got, len(bundle.labels)).alias("__p"))
    names = F.array(*(F.lit(x) for x in bundle.labels))
    top = F.array_max("__p")
    return got.select(
        *own,
        F.get(names, (F.array_position("__p", top) - 1).cast("int")).alias("label"),
        top.alias("confidence"),
        F.round(entropy_bits(F.col("__p")), 4).alias("entropy"),
        F.round(entropy_norm(F.col("__p")), 4).alias("entropy_norm"),
        (top < least).alias("is_anomaly"),
        F.map_from_arrays(names, F.transform("__p", lambda p: F.round(p, 4))).alias("probs"),
    )


def _left_out(rows: DataFrame, names: Sequence[str], fold: str, model: str) -> list[tuple[Any, Bundle]]:
    """Each value of ``fold`` with a model of all other rows, where these have two labels; ``PARALLEL`` are fitted at a time."""
    values = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    with ThreadPoolExecutor(PARALLEL) as pool:
        fitted = pool.map(lambda value: (value, fit_bundle(rows.where(F.col(fold) != value), names, model)), values)
        return [(value, bundle) for value, bundle in fitted if len(bundle.labels) > 1]


def channel_importance(rows: DataFrame, channels: Mapping[str, Sequence[str]], fold: str, model: str = "tree", repeats: int = 5, seed: int = 0, top: int = 20) -> DataFrame:
    """Drop in macro F1 when all columns of a channel are permuted together: channel, n_columns, importance_mean, importance_std.

    rows: clip, label, fold and the columns. Models are fitted without one value of ``fold`` (a video)
    and the rows of that value are permuted among themselves, so one task orders one video's clips. The
    ``top`` channels are returned, the largest drop first.
    """
    names = [c for columns in channels.values() for c in columns]
    rows = rows.select("clip", "label", F.col(fold).alias("fold"), *names).where("label is not null")
    trials = F.array(F.struct(F.lit("").alias("channel"), F.lit(0).alias("trial")), *(F.struct(F.lit(c).alias("channel"), F.lit(k).alias("trial")) for c in channels for k in range(repeats)))
    w = W.partitionBy("fold", "channel", "trial")
    drawn = rows.select("clip", "label", "fold", F.struct(*names).alias("own"), F.explode(trials).alias("t")).select("*", "t.*").drop("t")
    drawn = drawn.withColumn("place", F.row_number().over(w.orderBy("clip"))).withColumn("other", F.row_number().over(w.orderBy(F.xxhash64("clip", "channel", "trial", F.lit(seed)), "clip")))
    given = drawn.select("fold", "channel", "trial", F.col("other").alias("place"), F.col("own").alias("theirs"))
    mixed = drawn.drop("other").join(given, ["fold", "channel", "trial", "place"])
    mixed = mixed.select("clip", "fold", "channel", "trial", F.col("label").alias("y_true"), *(F.when(F.col("channel") == c, F.col(f"theirs.{n}")).otherwise(F.col(f"own.{n}")).alias(n) for c, columns in channels.items() for n in columns))
    mixed = stored(mixed, "permuted")  # every fold reads its part
    parts = [batch_score(mixed.where(F.col("fold") == value), bundle) for value, bundle in _left_out(rows, names, "fold", model)]
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    keys = ["fold", "channel", "trial"]
    f1 = classification_scores(scored.select(*keys, "y_true", F.col("label").alias("y_pred")), keys).select(*keys, "macro_f1")
    base = F.max(F.when(F.col("channel") == "", F.col("macro_f1"))).over(W.partitionBy("fold"))
    drop = F.col("base") - F.col("macro_f1")
    sizes = F.create_map(*(F.lit(x) for c, columns in channels.items() for x in (c, len(columns))))
    out = f1.withColumn("base", base).where("channel <> ''").groupBy("channel").agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))
    return out.select("channel", sizes[F.col("channel")].alias("n_columns"), "importance_mean", "importance_std").orderBy(F.desc("importance_mean"), "channel").limit(top)


def calibrate(rows: DataFrame, names: Sequence[str], model: str = "tree", most: int = 5, seed: int = 7) -> DataFrame:
    """Out-of-fold probabilities and their calibrated form: clip, y_true, probs, calibrated, y_pred, folds.

    Folds: ``most``, the smallest class, two at least. For each class a sigmoid of its out-of-fold
    probability is fitted (one logistic regression on one number), and the sigmoids are scaled to
    sum to one. If a class has one row, nothing is fitted: folds is 0, calibrated is probs.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = rows.where("label is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().orderBy("label").collect()}
    smallest = min(sizes.values(), default=0)
    folds = max(2, min(most, smallest))
    scored = stored(grouped_predictions(kfold(rows, folds, seed), names, "fold", model).select("clip", "y_true", "probs", "y_pred"), "scored")
    if smallest < 2:
        return scored.select("clip", "y_true", "probs", F.col("probs").alias("calibrated"), "y_pred", F.lit(0).alias("folds"))
    out = scored
    for k, label in enumerate(sizes):
        one = VectorAssembler(inputCols=["__x"], outputCol="__f").transform(scored.select("clip", F.get("probs", F.lit(k)).alias("__x"), (F.col("y_true") == label).cast("double").alias("__y")))
        sigmoid = LogisticRegression(featuresCol="__f", labelCol="__y", probabilityCol="__s", predictionCol="__b", rawPredictionCol="__r", maxIter=50).fit(one)
        a, b = float(sigmoid.coefficients[0]), float(sigmoid.intercept)
        out = out.withColumn(f"__s{k}", 1 / (1 + F.exp(-(a * F.get("probs", F.lit(k)) + b))))
    all_ = F.array(*(F.col(f"__s{k}") for k in range(len(sizes))))
    total = F.aggregate(all_, F.lit(0.0), lambda s, v: s + v)
    out = out.withColumn("calibrated", F.transform(all_, lambda v: F.when(total > 0, v / total).otherwise(1 / len(sizes))))
    names_ = F.array(*(F.lit(x) for x in sizes))
    return out.select("clip", "y_true", "probs", "calibrated", F.get(names_, (F.array_position("calibrated", F.array_max("calibrated")) - 1).cast("int")).alias("y_pred"), F.lit(folds).alias("folds"))
