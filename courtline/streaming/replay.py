"""Tables played as a stream: files in order, a restartable query, its written result."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(batches: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build`` over a stream whose micro-batches are the tables, in order; what it appended, once all are done.

    Each table is one partition's file in the shared folder, so it is one micro-batch: for replaying bounded
    recordings. The state store is RocksDB for this query, whatever the session has.
    """
    spark = batches[0].sparkSession
    top = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    for batch in batches:
        batch.select(*(F.col(c).cast(t).alias(c) for c, t in batches[0].dtypes)).coalesce(1).write.mode("append").parquet(f"{top}/in")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
        build(stream).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.parquet(f"{top}/out")


def cut(rows: DataFrame, by: str) -> list[DataFrame]:
    """Rows of each value of the column ``by`` (few values, known to the driver), in its order and without it; the table is computed and written once, in a folder for each value."""
    spark, path = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/cut-{uuid.uuid4().hex}"
    rows.repartition(by).write.partitionBy(by).parquet(path)
    kept = spark.read.schema(rows.schema).parquet(path)
    return [kept.where(F.col(by) == r[0]).drop(by) for r in kept.select(by).distinct().orderBy(by).collect()]


def played(rows: DataFrame, build: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], mode: str = "append", files: int = 8) -> None:
    """``build`` over a stream of the table's files, ``files`` of them a micro-batch, into a sink for foreachBatch.

    For streams whose end result doesn't depend on the order of rows.
    """
    spark = rows.sparkSession
    top = f"{shared_folder(spark)}/played-{uuid.uuid4().hex}"
    rows.write.parquet(f"{top}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{top}/in")
    build(stream).writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
