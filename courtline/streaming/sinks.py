"""Sinks of streams that give the same rows when a micro-batch is written again after a failure."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Sink = Callable[[DataFrame, int], None]


def rows_once(path: str) -> Sink:
    """For foreachBatch: a batch's rows go to a folder of their own, which a repeated batch replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def written_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that rows_once() wrote."""
    return spark.read.parquet(path).drop("batch_id")


def newest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Of rows written in update mode the newest for each key: what the running aggregate says now."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("newest"))
    return newest.select(*keys, "newest.*")


def live_label_counts(windows: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Windows with each label so far and how many of them are anomalies (is_anomaly); for update mode."""
    return windows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("n_anomalies"))
