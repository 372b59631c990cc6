"""Merkle manifest of a dataset, by lag and lead windows.

The rows of a part (a language) in order are the leaves of a tree in which every ``FAN``
consecutive nodes have a parent. A node is kept in the row of its first leaf, so on each level
its siblings are the rows a fixed number of places before and after: lag and lead columns,
masked by the node's slot among its siblings and by the length of their run, supply them, and
the rows of first children hash the parents. A window holds ``SPAN`` = 8**3 rows of one part, three
levels; the tops of the windows are the rows of the next pass, so a part that holds any share of all
rows is spread over as many tasks as it has windows. The parts' tops in order are the leaves of
one more tree.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .saved import saved

#: Fixed value: children of a node. Levels and leaves of a window.
FAN, LEVELS = 8, 3
SPAN = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIDES = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value as a leaf hashes it: its UTF-8 byte count, a colon and itself; '-' for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def placed(rows: DataFrame, part: str, *order: str) -> DataFrame:
    """``rows`` with at (place among the rows of its part, from 0) and n (rows of the part).

    Rows are dealt by ranges of (part, order), counted per range, and numbered inside their range
    from where it begins: no window holds a part. Rows that are equal in all of these are told
    apart by where they were written, so repeated rows fall into no one range.
    """
    known = saved(rows, "rows").withColumn("__id", F.monotonically_increasing_id())
    dealt = saved(known.repartitionByRange(part, *order, "__id").withColumn("__range", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(part, "__range").agg(F.count("*").alias("__many"))
    whole = W.partitionBy(part)
    before = F.coalesce(F.sum("__many").over(whole.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(part, "__range", before.alias("__before"), F.sum("__many").over(whole).alias("n"))
    within = F.row_number().over(W.partitionBy(part, "__range").orderBy(*order, "__id"))
    return dealt.withColumn("__within", within).join(starts, [part, "__range"]).withColumn("at", F.col("__before") + F.col("__within") - 1).drop("__id", "__range", "__within", "__before")


def _inside(nodes: DataFrame) -> DataFrame:
    """Nodes (part, at, n, hash) with window, and for each level k inside it left{k}, right{k} (of the node's ancestor there; null above the part's top) and hash{k}."""
    out = nodes.withColumn("window", F.floor(F.col("at") / SPAN).cast("long")).withColumn("hash0", F.col("hash"))
    places = W.partitionBy("part", "window").orderBy("at")
    so_far = places.rowsBetween(W.unboundedPreceding, 0)
    for k in range(LEVELS):
        step = FAN**k
        index = F.floor(F.col("at") / step)
        slot, many = F.pmod(index, F.lit(FAN)), F.ceil(F.col("n") / step)
        node, run = (F.col("at") % step == 0) & (many > 1), F.least(F.lit(FAN), many - index + slot)
        near = [F.when(slot >= j, F.lag(f"hash{k}", j * step).over(places)).otherwise("") for j in range(FAN - 1, 0, -1)]
        far = [F.when(slot + j < run, F.lead(f"hash{k}", j * step).over(places)).otherwise("") for j in range(1, FAN)]
        out = out.withColumn(f"left{k}", F.when(node, F.concat(*near))).withColumn(f"right{k}", F.when(node, F.concat(*far)))
        first = F.col("at") % (step * FAN) == 0
        out = out.withColumn(f"hash{k + 1}", F.when(first, F.when(many > 1, F.sha2(F.concat(f"hash{k}", f"right{k}"), 256)).otherwise(F.col(f"hash{k}"))))
    for k in range(LEVELS):
        out = out.withColumn(f"left{k}", F.last(f"left{k}", True).over(so_far)).withColumn(f"right{k}", F.last(f"right{k}", True).over(so_far))
    return out


def climb(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (part, at, n, hash) inside their windows, and the written table of windows: part, window, further (what stands beside the ancestors above the window), top (the part's root).

    most: the largest n. Each pass takes three levels; the tops of its windows are the next pass's nodes.
    """
    inside = _inside(nodes)
    tops = inside.where(F.col("at") % SPAN == 0).select("part", F.col("window").alias("at"), F.ceil(F.col("n") / SPAN).cast("long").alias("n"), F.col(f"hash{LEVELS}").alias("hash"))
    tops = saved(tops, "nodes")
    if most > SPAN:
        above = trees(*climb(tops, ceil(most / SPAN))).select("part", F.col("at").alias("window"), F.col("sides").alias("further"), "top")
    else:
        above = tops.select("part", F.col("at").alias("window"), F.array().cast(SIDES).alias("further"), F.col("hash").alias("top"))
    return inside, saved(above, "windows")


def trees(inside: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes with their windows' columns and sides: what stands left and right of the node and each of its ancestors below the root, upward."""
    own = F.filter(F.array(*(F.when(F.col(f"left{k}").isNotNull(), F.struct(F.col(f"left{k}").alias("left"), F.col(f"right{k}").alias("right"))) for k in range(LEVELS))), lambda s: s.isNotNull())
    return inside.withColumn("own", own).join(above, ["part", "window"]).withColumn("sides", F.concat("own", "further"))


def fold(start: Column, sides: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(sides, start, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]), 256))


def proof(sides: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(sides, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """One row per row of documents: doc_id, leaf, subroot (of its lang), root, proof_sha256, folded_root, verified.

    ``tampered`` says which rows are checked with the text ``text`` instead of their own;
    their proofs are those of the untouched rows. Leaves of a lang are in ascending order of
    doc_id (none first; equal ids in the order of their hashes, rows equal in both are alike), langs in the order of their bytes (none first).

    Any column may be null: a null hashes as '-', unlike the empty text. Long texts are hashed where
    they are read; only digests are shuffled. A lang with one row has that leaf as its subroot, and one lang
    alone gives its subroot as root. Rows that are repeated are leaves each. No rows give no rows; other columns
    are not looked at.
    """
    own = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    body = F.col("text").cast("string")
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf(*own, text)) if tampered is not None else F.lit(None).cast("string")
    # null sorts before any text, and '' keeps its own place
    part = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), own[2]))
    rows = docs.select(own[0].alias("doc_id"), part.alias("part"), leaf(*own, body).alias("hash"), other.alias("other"))
    leaves = saved(placed(rows, "part", "doc_id", "hash"), "leaves")
    inside, above = climb(leaves, leaves.agg(F.max("n")).first()[0] or 0)
    langs = saved(placed(above.where("window = 0").select(F.lit("").alias("part"), F.col("part").alias("lang"), F.col("top").alias("hash")), "part", "lang"), "langs")
    upper = trees(*climb(langs, langs.count())).select(F.col("lang").alias("part"), F.col("sides").alias("highest"), F.col("top").alias("root"))
    above = above.join(upper, "part").withColumn("further", F.concat("further", "highest")).drop("highest")
    out = trees(inside, above)
    folded = fold(F.coalesce("other", "hash"), F.col("sides"))
    out = out.select("doc_id", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "root", proof(F.col("sides")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
