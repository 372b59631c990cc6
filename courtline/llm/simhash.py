"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits. Two fingerprints with at most ``DIFFERING`` = 2 differing bits are
cut into two halves; one half differs by one bit at most, so they agree in some signature that
keeps a half without one of its bits: 64 signatures per fingerprint, joined by equality. A signature that
more than ``SMALL`` fingerprints share is cut again: the other half has two differing bits at
most, so a quarter of the word without one of its bits is added, and then an eighth. Three cuts leave
eleven bits free, so no bucket is ever larger than 2,048 distinct fingerprints, whatever the data.
Inside a bucket every pair is verified; links come out as stars, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as X
from .saved import attach, components, saved

SHINGLE, SEED, DIFFERING = 3, 42, 2
#: Larger buckets are cut again (an exact way, not a cap); rows of a task's bundle of buckets.
SMALL, BUNDLE_ROWS = 512, 200_000
#: Bits of a segment on each level of cutting: halves, quarters, eighths of the word.
WIDTHS = (32, 16, 8)
#: Hashes whose bits are counted at a time.
STEP = 1 << 16


def _fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of a block; rows without words have 0."""
    data = X.LOWER[data]
    starts, ends, first = X.words(data, offs, X.NOT_SPACE)
    length = ends - starts
    # words with one space after each: a shingle is a slice of it
    after = np.cumsum(length + 1)
    begin = after - length - 1
    joined = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[X.NOT_SPACE[data]]
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(1, n_words - SHINGLE + 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row]
    last = at + np.minimum(SHINGLE, n_words[row]) - 1
    text, h64 = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([h64(text[a:b], SEED) for a, b in zip(begin[at].tolist(), (begin + length)[last].tolist(), strict=True)], np.uint64)
    ones = np.zeros((len(n), 64), np.int64)
    for a in range(0, len(h), STEP):
        of = row[a : a + STEP]
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        bits = np.unpackbits(h[a : a + STEP, None].view(np.uint8), axis=1, bitorder="little")
        ones[of[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in X.blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_fingerprints(data, offs).view(np.int64))], names=["doc_id", "fp"])


def _masks(width: int) -> list[int]:
    """For each bit of the word: its segment without the bit itself, as signed 64-bit numbers."""
    out = [(((1 << width) - 1) << (p // width * width)) & ~(1 << p) for p in range(64)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _kept(pos: Column, level: int) -> Column:
    """The bits that a signature keeps: of each segment that was cut, all but the bit left out (pos has these in base 64)."""
    out = F.lit(0).cast("long")
    for k in range(level + 1):
        masks = F.array(*(F.lit(m).cast("long") for m in _masks(WIDTHS[k])))
        out = out.bitwiseOR(F.get(masks, F.pmod(F.shiftright(pos, 6 * (level - k)), F.lit(64))))
    return out


def _signatures(rows: DataFrame, level: int) -> DataFrame:
    """Rows with fp, and below the first level pos, to one row per variant: fp, pos (bits that were left out), key (hash of the signature).

    The bit to leave out is any outside the segments that are cut already. Two signatures with one
    hash only share a bucket.
    """
    if level == 0:
        out = rows.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    else:
        # the last bit left out lies in a segment of twice the width; that segment's sibling is still free
        twice = 2 * WIDTHS[level]
        free = (F.floor(F.pmod(F.col("pos"), F.lit(64)) / twice).cast("int").bitwiseXOR(F.lit(1)) * twice).cast("int")
        out = rows.select("fp", F.explode(F.transform(F.sequence(free, free + (twice - 1)), lambda p: F.col("pos") * 64 + p)).alias("pos"))
    return out.withColumn("key", F.xxhash64(F.lit(level), F.col("pos"), F.col("fp").bitwiseAND(_kept(F.col("pos"), level))))


def _compare(table: pa.Table) -> pa.Table:
    """Every pair inside each bucket of a bundle is verified: an edge from each fingerprint to the least one it reaches."""
    table = table.sort_by([("key", "ascending"), ("fp", "ascending")]).combine_chunks()
    key, fp = table.column("key").to_numpy(), table.column("fp").to_numpy()
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[head, len(fp)])
    left, right = [], []
    for m in np.unique(size[size > 1]):
        of = head[size == m]
        step = max(1, (1 << 21) // int(m * m))
        for a in range(0, len(of), step):
            x = fp[of[a : a + step, None] + np.arange(m)]
            bits = x.view(np.uint64)
            near = np.bitwise_count(bits[:, :, None] ^ bits[:, None, :]) <= DIFFERING
            root = np.broadcast_to(np.arange(m), x.shape)
            while True:
                new = np.where(near, root[:, None, :], m).min(axis=2)
                if (new == root).all():
                    break
                root = new
            i, j = np.nonzero(root != np.arange(m))
            left.append(x[i, j])
            right.append(x[i, root[i, j]])
    out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def links(fingerprints: DataFrame) -> DataFrame:
    """(a, b) stars over distinct fingerprints (fp): two are connected by stars if and only if they are by links."""
    level, buckets = _signatures(fingerprints.select("fp"), 0), None
    for k in range(len(WIDTHS)):
        counts = saved(level.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "counts")
        # shared signatures grow with the data: never broadcast
        met = saved(attach(level, counts.hint("merge"), "key", counts.withColumnRenamed("many", "n")), "buckets")
        large = F.col("many") > SMALL if k < len(WIDTHS) - 1 else F.lit(False)
        ready = met.where(~large).select("key", "fp")
        buckets = ready if buckets is None else buckets.unionByName(ready)
        if met.where(large).isEmpty():
            break
        level = _signatures(met.where(large).select("fp", "pos"), k + 1)
    bundles = max(16, buckets.count() // BUNDLE_ROWS)
    return buckets.withColumn("bundle", F.pmod("key", F.lit(bundles))).groupBy("bundle").applyInArrow(_compare, "a long, b long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id.

    A-Z are lower-cased; a word is what stands between white space (space, tab to carriage return); the
    words of a text give shingles of three, repeats included, a shorter text one of all its
    words. A bit of fp is 1 if it is set in over half of the shingles' 64-bit hashes (XXH64, seed
    42). Fingerprints with two differing bits or fewer are linked; component_id is the least doc_id that links
    reach.

    Null, empty and blank texts have no words and the fingerprint 0, which is linked like any other.
    Rows without doc_id have a fingerprint and link others; their component_id is null if the
    component has no id at all. Rows that repeat a doc_id have each its own row. Long texts are
    read whole, one at a time. No rows give no rows; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = saved(rows.mapInArrow(_signed, "doc_id long, fp long"), "fingerprints")
    each = saved(signed.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    found = components(links(each)).toDF("fp", "component")
    named = saved(each.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    facts = attach(named.select("fp", "component"), least.select("component", "component_id"), "component", least)
    return attach(signed, facts.select("fp", "component_id"), "fp", each)
