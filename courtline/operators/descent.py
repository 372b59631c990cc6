"""Softmax regression by gradient descent over Spark, with a row of figures for each epoch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored

#: Sums that a pass over the rows yields: cells of the gradient, confusion counts and losses of both parts.
SUMS = "kind string, i int, j int, v double"
HISTORY = "epoch int, train_loss double, train_acc double, val_loss double, val_acc double, val_macro_f1 double, val_balanced_acc double"


def _pass(weights: np.ndarray, balance: np.ndarray):
    """(y, part, features) to sums of a partition: one row a cell, whatever the partition's size."""
    k, d = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, confusion, loss = np.zeros((k, d)), np.zeros((2, k, k)), np.zeros(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.asarray(batch.column(2).flatten()).reshape(len(y), d - 1)
            x = np.concatenate([x, np.ones((len(y), 1))], axis=1)
            z = x @ weights.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            np.add.at(confusion, (part, y, p.argmax(axis=1)), 1)
            np.add.at(loss, part, -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)))
            off, mine = p - np.eye(k)[y], part == 0
            gradient += (off[mine] * balance[y[mine]][:, None]).T @ x[mine]
        for kind, cells in (("gradient", gradient), ("train", confusion[0]), ("val", confusion[1]), ("loss", loss[:, None])):
            i, j = np.indices(cells.shape)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * cells.size), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(cells.ravel())], names=["kind", "i", "j", "v"])

    return run


def _figures(confusion: np.ndarray, loss: float) -> tuple[float, float, float, float]:
    """Mean loss, accuracy, macro F1 over all classes and balanced accuracy over those that occur."""
    n, hit, of, told = confusion.sum(), np.diag(confusion), confusion.sum(axis=1), confusion.sum(axis=0)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    f1 = np.where(of + told > 0, 2 * hit / np.maximum(of + told, 1), 0.0)
    return loss / n, hit.sum() / n, float(f1.mean()), float((hit[of > 0] / of[of > 0]).mean())


def training_history(rows: DataFrame, names: Sequence[str], epochs: int = 20, rate: float = 0.5, patience: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(history, weights of the best epoch) of a softmax regression trained by full gradient descent.

    rows: label, is_val (boolean) and the features ``names``. Features are scaled by mean and deviation of the training
    part, a null is its mean; classes of the training part weigh alike. An epoch is one pass over the rows: partitions hand on sums
    of a fixed size, which are added up by a shuffle, and the driver gets one number a cell of the weights. The figures of
    an epoch are those of the weights that it begins with, which are zeros for epoch 1. The best epoch has the highest macro F1 of the other part, the last of equal ones, and with ``patience`` training
    ends that many epochs after it. Rows without a label are passed over. The first row of weights belongs
    to the first label by name; the last column is the bias.
    """
    spark = rows.sparkSession
    rows = stored(rows.where("label is not null").select("label", F.coalesce("is_val", F.lit(False)).alias("is_val"), *(F.col(n).cast("double").alias(n) for n in names)), "descent")
    labels = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    if not labels:
        return spark.createDataFrame([], HISTORY), np.zeros((0, len(names) + 1))
    train = rows.where("not is_val")
    mean, dev = (np.array([v or 0.0 for v in train.agg(*(f(n) for n in names)).first()]) for f in (F.avg, F.stddev_pop))
    size = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    n, k = sum(size.values()), len(labels)
    balance = np.array([n / (len(size) * size[x]) if x in size else 0.0 for x in labels])
    ids = F.create_map(*(F.lit(x) for i, v in enumerate(labels) for x in (v, i)))
    scaled = F.array(*(F.coalesce((F.col(c) - float(m)) / float(s or 1.0), F.lit(0.0)) for c, m, s in zip(names, mean, dev, strict=True)))
    given = stored(rows.select(ids[F.col("label")].alias("y"), F.col("is_val").cast("int").alias("part"), scaled.alias("x")), "scaled")

    weights, best, kept, history = np.zeros((k, len(names) + 1)), (-1.0, 0), None, []
    for epoch in range(1, epochs + 1):
        sums = given.mapInArrow(_pass(weights, balance), SUMS).groupBy("kind", "i", "j").agg(F.sum("v").alias("v")).collect()
        got = {"gradient": np.zeros_like(weights), "train": np.zeros((k, k)), "val": np.zeros((k, k)), "loss": np.zeros((2, 1))}
        for r in sums:
            got[r.kind][r.i, r.j] = r.v
        ours, theirs = _figures(got["train"], got["loss"][0, 0]), _figures(got["val"], got["loss"][1, 0])
        history.append((epoch, *map(float, ours[:2]), *map(float, theirs)))
        if theirs[2] >= best[0]:
            best, kept = (theirs[2], epoch), weights
        if patience is not None and epoch - best[1] >= patience:
            break
        weights = weights - rate * got["gradient"] / max(n, 1)
    return spark.createDataFrame(history, HISTORY), kept
