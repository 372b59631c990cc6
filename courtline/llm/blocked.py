"""Documents dealt into blocks of neighbouring doc_id, and questions between blocks.

A repeated-passage operator works in rounds. Each block of documents asks about its
distinct hashes or contexts: one binary row per (block, bucket). A bucket holds all
that any block asks about one range of hashes, answers with one bit string per block,
and the answers meet the block's text again in a cogroup. What a block asks is distinct,
so a passage that a third of all documents repeat costs one entry per block, never one
per document, and no pair of documents is ever formed. The exchange of texts by block is
the same in every round, so Spark writes it once and reuses it.

Blocks are ordered like doc_id: an earlier block has only smaller ids.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASK = "blk long, bucket long, payload binary"
MIN_BLOCK, MAX_BLOCK, CELLS, PIECE = 2 << 20, 64 << 20, 128, 1024


def _quantiles(many: int) -> Column:
    """Aggregate over one row per piece of text: ids that cut the bytes in ``many`` equal parts."""
    return F.percentile_approx("doc_id", [i / many for i in range(1, many)], max(10_000, 8 * many)) if many > 1 else F.array().cast("array<long>")


def deal(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int, int]:
    """(doc_id, text, blk) of the rows with an id, number of blocks, bytes of text.

    Blocks are cut where the bytes of text in the order of ids reach equal shares, so clustered
    ids and long texts fill no block more than others: first ``CELLS`` cuts, then, if there are more
    blocks, cuts inside each cell. Only ids and lengths are looked at; what reaches the driver is one
    id per block. All rows of one doc_id are in one block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    size_of = F.coalesce(F.octet_length("text"), F.lit(0))
    pieces = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor(size_of / PIECE).cast("int")), lambda k: F.least(F.lit(PIECE), size_of - k * PIECE))).alias("bytes"))
    size, cells = pieces.agg(F.sum("bytes"), _quantiles(CELLS)).first()
    size = int(size or 0)
    n = max(1, ceil(size / min(MAX_BLOCK, max(MIN_BLOCK, size // 2000))))
    cells = sorted(set(cells or []))
    if n <= CELLS:
        cuts = sorted({cells[ceil(i * len(cells) / n) - 1] for i in range(1, n)}) if cells else []
    else:
        each = ceil(n / (len(cells) + 1))
        inner = pieces.groupBy(_place(cells).alias("cell")).agg(_quantiles(each).alias("cuts")).collect()
        cuts = sorted({*cells, *(c for r in inner for c in r["cuts"] or [])})
    return rows.withColumn("blk", _place(cuts)), len(cuts) + 1, size


def _place(cuts: list[int]) -> Column:
    """Number of cuts below doc_id, by binary search."""
    if not cuts:
        return F.lit(0).cast("long")
    table, steps = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>"), [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    further = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(table, at + step - 1) < F.col("doc_id")), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further).cast("long")


def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The block's rows by doc_id (none last), their ids (0 where null), and which have an id."""
    table = table.combine_chunks().sort_by([("doc_id", "ascending")]) if table.num_rows else table
    ids = table.column("doc_id")
    has = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool)
    return table, ids.fill_null(0).to_numpy().astype(np.int64), has


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def asks(blk: int, bucket: np.ndarray, payload) -> pa.Table:
    """One row per bucket from entries sorted by bucket; payload(lo, hi) gives its bytes."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(bucket)] if len(at) else at
    return pa.table({"blk": pa.array(np.full(len(at), blk, np.int64)), "bucket": pa.array(bucket[at] if len(at) else at, pa.int64()), "payload": pa.array([payload(a, b) for a, b in zip(at, ends, strict=True)], pa.binary())})


def distinct(bucket: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each distinct (bucket, h) in that order, and each entry's place among them."""
    order = np.lexsort((h, bucket))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def answers(table: pa.Table, n: int) -> np.ndarray:
    """The bits of a block's answers, in the order in which it asked n entries."""
    if not n:
        return np.zeros(0, bool)
    table = table.sort_by([("bucket", "ascending")])
    out = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8)[4:], count=int(np.frombuffer(x, np.int32, 1)[0])) for x in table.column("payload").to_pylist()])
    if len(out) != n:
        raise ValueError(f"{n} entries were asked and {len(out)} answered")
    return out.astype(bool)


def packed(bits: np.ndarray) -> bytes:
    return np.int32(bits.size).tobytes() + np.packbits(bits.reshape(-1)).tobytes()


def key_of(key) -> int:
    return int(key[0].as_py() if hasattr(key[0], "as_py") else key[0])
