"""Tables written to the folder that all executors share, joins that spread hot keys, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ``MOST`` most frequent keys with more than ``FEW`` rows each are hot; their rows go to ``SALTS`` places.
MOST, FEW, SALTS = 1000, 1000, 64


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a written table, one folder for each value of ``by``: its lineage is cut and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, facts: DataFrame, key: str, many: DataFrame, how: str = "inner", also: str | None = None) -> DataFrame:
    """Join of ``rows`` with ``facts`` (one row per key) in which no task gets all rows of a hot key.

    many: (key, n), the rows per key; ``also`` names a second key column that is not looked at for
    heat. Of keys with more than ``FEW`` rows the ``MOST`` most frequent ones, which alone reach the
    driver, are hot: any other has less than a thousandth of all rows. The rows of hot keys are dealt
    to ``SALTS`` places, and their facts to each.
    """
    keys = [key, also] if also else [key]
    hot = [r[0] for r in many.where(F.col("n") > FEW).orderBy(F.desc("n"), key).select(key).limit(MOST).collect()]
    if not hot:
        return rows.join(facts, keys, how)
    left = rows.withColumn("__salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int"))
    right = facts.withColumn("__salt", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); a component is named by its least node.

    Alternates large-star and small-star steps until the edges are stars around the least
    nodes; each round is written and reread, and only counts and whether it is the last reach the
    driver. A node with many edges is no hot key: see ``attach``. Self-loops and repeated edges
    don't matter. No edges: no rows.
    """
    down = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = saved(edges.where("a <> b").select(*down("a", "b")).distinct(), "edges")
    while True:
        # a node's larger neighbours go to the least of its smaller ones, or to itself
        least = now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
        large = attach(now, least, "b", now.groupBy("b").agg(F.count("*").alias("n")), "left").select("a", F.coalesce("m", "b").alias("b"))
        large = saved(large.distinct(), "edges")
        # and its smaller neighbours, like itself, to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = attach(large, least.select("a", "m"), "a", least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        ends = now.groupBy("a").agg(F.count("*").alias("n"))
        if ends.where("n > 1").isEmpty() and now.select("b").distinct().join(ends.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():  # stars around least nodes
            return now.toDF("node", "component").unionByName(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
