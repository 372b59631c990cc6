"""Merkle fixity audit of WARC replicas, in DataFrame operations.

Records are hashed; the records of one offset range of a file make a leaf, ``FAN`` ranges in
order make a node above, up to the file, and files make nodes by the digits of their hashed
names, up to one root per replica. Replicas are compared from their roots; below a pair of
nodes that agree nothing is looked at, so an audit reads only the branches that differ, down to
the records.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .saved import saved

#: Bytes of a leaf's offset range, and children of an inner node.
RANGE, FAN = 1 << 16, 16


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """One response record as text."""
    html = F.coalesce(body.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, per_file: int = 256) -> DataFrame:
    """Pages laid out as WARC files: file, start, length, digest, record_id.

    A file holds ``per_file`` consecutive page ids, in id order; rows without id go to file -1.
    Only lengths and digests are shuffled, never bodies.
    """
    text = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("record_id"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"), F.sha2(F.concat(text, F.lit("#")), 256).alias("damaged"))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("record_id") / per_file), F.lit(-1)).cast("long"))
    before = W.partitionBy("file").orderBy("record_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _parent(k: int, range_levels: int, file_levels: int) -> tuple[Column, Column]:
    """File and place of the node above a node of level k."""
    if k < range_levels:
        return F.col("file"), F.floor(F.col("at") / FAN).cast("long")
    if k == range_levels:
        return F.lit(""), F.pmod(F.xxhash64("file"), F.lit(FAN**file_levels))
    return F.lit(""), F.floor(F.col("at") / FAN).cast("long")


def _at() -> Column:
    return F.floor(F.col("start") / RANGE).cast("long")


def merkle_levels(records: DataFrame, range_levels: int, file_levels: int) -> list[DataFrame]:
    """(file, at, hash) of each level from the leaves up, each a written table; the last level is one root, file is '' above files.

    records: file, start, length, digest. Repeated rows are one record with a multiplicity, so a
    leaf holds at most what fits in its range.
    """
    one = records.groupBy("file", "start", "length", "digest").agg(F.count("*").alias("copies"))
    item = F.struct("start", F.concat_ws(":", F.col("start").cast("string"), F.col("length").cast("string"), F.col("copies").cast("string"), "digest").alias("hash"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["hash"])
    levels = [saved(one.groupBy("file", _at().alias("at")).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("hash")), "level")]
    for k in range(range_levels + 1 + file_levels):
        file, at = _parent(k, range_levels, file_levels)
        child = F.transform(F.array_sort(F.collect_list(F.struct("at", "of", "hash"))), lambda x: F.concat_ws(":", x["at"].cast("string"), x["of"], x["hash"]))
        above = levels[-1].select(file.alias("up_file"), at.alias("up"), "at", F.col("file").alias("of"), "hash").groupBy("up_file", "up").agg(F.sha2(F.array_join(child, "\n"), 256).alias("hash"))
        levels.append(saved(above.toDF("file", "at", "hash"), "level"))
    return levels


def _differing(a: DataFrame, b: DataFrame, above: DataFrame | None, file: Column | None = None, at: Column | None = None) -> DataFrame:
    """(file, at) of nodes of one level that differ, among the children of the nodes ``above``."""
    if above is not None:
        up = above.toDF("up_file", "up")
        a, b = (x.withColumn("up_file", file).withColumn("up", at).join(up, ["up_file", "up"], "left_semi").select("file", "at", "hash") for x in (a, b))
    both = a.withColumnRenamed("hash", "left").join(b.withColumnRenamed("hash", "right"), ["file", "at"], "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right"))).select("file", "at")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where do two replicas differ? One row per place where they do.

    Both have file, start, length, digest and record_id. Returns file, start, record_id, length
    and kind: 'corrupt' (both have a record there, and bytes, lengths or counts differ),
    'missing' (only the left replica has one) or 'extra' (only the right one). Where several
    records start at one place, the least id and length are told.

    Equal replicas, two empty ones included, give no rows; an empty replica makes every record
    of the other missing or extra. Rows repeated in one replica are one record with a count. A
    null file is the file '', a null start is -1, a null digest or length is a value of its own.
    Other columns are not looked at.
    """
    clean = (F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), F.coalesce(F.col("start").cast("long"), F.lit(-1)).alias("start"), F.col("length").cast("long").alias("length"), F.coalesce("digest", F.lit("null")).alias("digest"), "record_id")
    sides = [saved(x.select(*clean), "records") for x in (left, right)]
    got = [x.agg(F.max("start"), F.approx_count_distinct("file")).first() for x in sides]
    range_levels = max(1, ceil(log(max(2, *((g[0] or 0) // RANGE + 1 for g in got)), FAN)))
    file_levels = max(1, ceil(log(max(2, *(g[1] for g in got)), FAN)))
    a, b = (merkle_levels(x, range_levels, file_levels) for x in sides)
    differ = _differing(a[-1], b[-1], None)
    for k in range(len(a) - 2, -1, -1):
        differ = saved(_differing(a[k], b[k], differ, *_parent(k, range_levels, file_levels)), "differing")
    found = []
    for x in sides:
        near = x.withColumn("at", _at()).join(differ, ["file", "at"], "left_semi")
        found.append(near.groupBy("file", "start").agg(F.min("record_id").alias("record_id"), F.min("length").alias("length"), F.count("*").alias("many"), F.array_sort(F.collect_set(F.struct("digest", "length"))).alias("bytes")))
    x, y = (f.select("file", "start", F.struct("record_id", "length", "many", "bytes").alias(n)) for f, n in zip(found, ("x", "y"), strict=True))
    both = x.join(y, ["file", "start"], "full_outer")
    kind = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(~((F.col("x.many") == F.col("y.many")) & (F.col("x.bytes") == F.col("y.bytes"))), "corrupt")
    return both.select("file", "start", F.coalesce("x.record_id", "y.record_id").alias("record_id"), F.coalesce("x.length", "y.length").alias("length"), kind.alias("kind")).where("kind is not null")
