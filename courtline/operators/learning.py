"""Label centres, as-of calibration and model evaluation over clip features."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import neighbours, scan
from .stored import stored

#: Models that are fitted at the same time: the jobs of one are too short to fill a cluster.
PARALLEL = 8


def label_centres(rows: DataFrame) -> DataFrame:
    """Mean embedding of each label."""
    cells = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return cells.groupBy(F.col("label").alias("team")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))


def calibration_asof(frames: DataFrame, calibrations: DataFrame, values: Sequence[str], key: str = "video_id", frame: str = "frame", chunk: int = scan.CHUNK) -> DataFrame:
    """Each frame with the latest calibration at or before it; one that failed (null) keeps the one before.

    calibrations: key, frame (one row each) and the values, which are numbers, all null where detection
    failed. The frame of the last calibration comes by a prefix scan, so no window holds a
    video, and its values by a join.
    """
    kinds = dict(frames.dtypes)
    good = calibrations.where(F.col(values[0]).isNotNull()).select(key, frame, F.col(frame).cast("double").alias("__own"))
    ticks = frames.select(key, frame).distinct().join(good, [key, frame], "full_outer")
    step = F.array(F.coalesce("__own", F.lit(0.0)), F.col("__own").isNotNull().cast("double"))
    out = scan.prefix_scan(ticks.select(F.col(key).alias("key"), F.col(frame).alias("at"), step.alias("map")), scan.last_known, chunk)
    out = out.select(F.col("key").alias(key), F.col("at").cast(kinds[frame]).alias(frame), F.when(F.get("map", F.lit(1)) > 0, F.get("map", F.lit(0))).cast(kinds[frame]).alias("__at"))
    known = calibrations.where(F.col(values[0]).isNotNull()).select(key, F.col(frame).alias("__at"), *values)
    return frames.select(key, frame).join(out, [key, frame], "left").join(known, [key, "__at"], "left").select(key, frame, *values)


def preparation(names: Sequence[str]) -> list:
    """Stages of median imputation and scaling of columns ``names`` into features."""
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"{n}__in" for n in names]
    return [Imputer(strategy="median", inputCols=list(names), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def model_pipeline(names: Sequence[str], model: str = "logistic", many: int = 2, present: Sequence[int] | None = None):
    """Median imputation, scaling and a classifier on columns ``names`` for label_id and weight.

    many: number of labels; present: those of the training rows (all). ``gbt`` knows two classes, so each label present
    is fitted against the rest on its column of ``against_rest``. ``mlp`` takes no weights.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier

    whole = {"featuresCol": "features", "labelCol": "label_id"}
    present = range(many) if present is None else present
    kinds = {
        "logistic": lambda: [LogisticRegression(**whole, weightCol="weight", maxIter=20, regParam=0.01)],
        "forest": lambda: [RandomForestClassifier(**whole, weightCol="weight", numTrees=50, seed=7)],
        "tree": lambda: [DecisionTreeClassifier(**whole, weightCol="weight", seed=7)],
        "gbt": lambda: [GBTClassifier(featuresCol="features", labelCol=f"is_{k}", weightCol="weight", predictionCol=f"hit_{k}", maxIter=20, maxDepth=3, seed=7).setRawPredictionCol(f"margin_{k}").setProbabilityCol(f"share_{k}") for k in present],
        "mlp": lambda: [MultilayerPerceptronClassifier(**whole, layers=[len(names), 128, 64, many], maxIter=100, seed=7)],
    }
    return Pipeline(stages=[*preparation(names), *kinds[model]()])


def against_rest(rows: DataFrame, many: int) -> DataFrame:
    """Adds is_0, is_1, … for ``many`` labels: 1 where label_id is that label, else 0."""
    return rows.select("*", *((F.col("label_id") == k).cast("double").alias(f"is_{k}") for k in range(many)))


def class_probabilities(scored: DataFrame, many: int) -> Column:
    """One array of ``many`` probabilities that sum to one from whatever a model of ``model_pipeline`` puts out.

    The probabilities of models against the rest are scaled to sum to one; a label without a model has 0.
    If all are 0, the labels with a model are equally likely.
    """
    from pyspark.ml.functions import vector_to_array

    if "probability" in scored.columns:
        return vector_to_array("probability")
    there = [k for k in range(many) if f"share_{k}" in scored.columns]
    share = {k: F.get(vector_to_array(f"share_{k}"), F.lit(1)) for k in there}
    total = sum(share.values(), F.lit(0.0))
    return F.array(*(F.when(total > 0, share[k] / total).otherwise(1 / len(there)) if k in share else F.lit(0.0) for k in range(many)))


def neighbour_probabilities(train: DataFrame, rows: DataFrame, names: Sequence[str], many: int, k: int = 5) -> DataFrame:
    """vec_id and probs of ``rows`` by their ``k`` nearest rows of ``train``, each weighted with 1 / distance.

    Both have vec_id, names and train label_id; features are filled and scaled by what ``train`` shows. No
    row is its own neighbour. Neighbours at no distance outweigh all others.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    ready = Pipeline(stages=preparation(names)).fit(train)
    vectors = lambda df: ready.transform(df).select("vec_id", F.col("label_id").cast("int").alias("label"), vector_to_array("features").alias("embedding"))
    near = neighbours.knn(vectors(rows), vectors(train), k)
    weight = 1 / F.greatest(F.sqrt("d2"), F.lit(1e-12))
    votes = near.groupBy(F.col("query_id").alias("vec_id")).agg(*(F.sum(F.when(F.col("label") == c, weight).otherwise(0.0)).alias(f"__w{c}") for c in range(many)), F.sum(weight).alias("__w"))
    return votes.select("vec_id", F.array(*(F.col(f"__w{c}") / F.col("__w") for c in range(many))).alias("probs"))


def grouped_predictions(rows: DataFrame, names: Sequence[str], fold: str, model: str = "logistic") -> DataFrame:
    """Out-of-fold predictions, leaving out one value of ``fold`` at a time (folds, videos).

    rows: clip, label, fold and the features. All preprocessing and the class weights are fitted
    on the training part alone. Folds without two labels to train on are left out. model: one of
    ``model_pipeline`` or ``knn``.
    """
    rows = rows.select("clip", "label", fold, *names)
    rows = stored(rows.withColumn("vec_id", F.monotonically_increasing_id()) if model == "knn" else rows, "grouped")  # every fold reads all features again
    labels = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    ids = F.create_map(*(F.lit(x) for k, v in enumerate(labels) for x in (v, float(k))))
    rows = rows.withColumn("label_id", ids[F.col("label")])
    named = F.array(*(F.lit(x) for x in labels))
    likeliest = F.get(named, (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))

    def scored(value) -> DataFrame | None:
        train, test = rows.where((F.col(fold) != value) & F.col("label_id").isNotNull()), rows.where(F.col(fold) == value)
        counts = {r[0]: r[1] for r in train.groupBy("label_id").count().collect()}
        if len(counts) < 2:
            return None
        if model == "knn":
            got = test.join(neighbour_probabilities(train, test, names, len(labels)), "vec_id")
            return got.select("clip", fold, F.col("label").alias("y_true"), likeliest.alias("y_pred"), "probs")
        weights = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, sum(counts.values()) / (len(counts) * n))))
        train = against_rest(train, len(labels)).withColumn("weight", weights[F.col("label_id")])
        got = model_pipeline(names, model, len(labels), sorted(int(k) for k in counts)).fit(train).transform(test.withColumn("weight", F.lit(1.0)))
        got = got.withColumn("probs", class_probabilities(got, len(labels)))
        chosen = F.get(named, F.col("prediction").cast("int")) if "prediction" in got.columns else likeliest
        return got.select("clip", fold, F.col("label").alias("y_true"), chosen.alias("y_pred"), "probs")

    with ThreadPoolExecutor(PARALLEL) as pool:
        parts = [p for p in pool.map(scored, [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]) if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
