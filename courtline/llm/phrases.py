"""Document fingerprints by locally consistent parsing.

Runs of one symbol become one symbol. Then deterministic coin tossing gives each symbol a
label of a few values, from the lowest bit in which it differs from its left neighbour, three
times over; a phrase begins where the label is a local maximum. Phrases are named by their
contents and parsed again, level by level, until a text is one phrase, so the number of levels
follows its length. A phrase's borders depend on a few symbols around it only, so equal
substrings are cut alike inside, wherever they stand. The fingerprint keeps, of the names of
all levels, the least in each of ``BINS`` hash ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import blocked as B
from . import textarrays as X

BINS = 64
#: More blocks than this and their borders are joined by a shuffle instead of a broadcast.
BROADCAST_BLOCKS = 1 << 16

_SMALL = np.arange(128)
_LOW = _SMALL[:, None] ^ _SMALL[None, :]
_LOW_BIT = np.where(_LOW == 0, 0, np.log2(np.maximum(_LOW & -_LOW, 1)).astype(np.int64))
#: Label of a symbol under 128 from its left neighbour's and its own.
_TOSS = (2 * _LOW_BIT + ((_SMALL[None, :] >> _LOW_BIT) & 1)).astype(np.uint8)


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each row of symbols, and each row's first phrase (n+1 values)."""
    n = len(names)
    if not n:
        return names, first
    head = np.zeros(n + 1, bool)
    head[first] = True
    new = head[:n].copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.r_[at, n]).astype(np.uint64)
    symbol = X.mix(names[at] + length * np.uint64(0x9E3779B97F4A7C15))
    head = head[at]
    differ = symbol.copy()
    differ[1:] ^= symbol[:-1]
    low = differ & (~differ + np.uint64(1))
    bit = np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.uint64)
    label = (2 * bit + ((symbol >> bit) & np.uint64(1))).astype(np.uint8)
    label[head] = (symbol[head] & np.uint64(127)).astype(np.uint8)
    for _ in range(2):
        before = np.r_[np.uint8(0), label[:-1]]
        tossed = _TOSS[before, label]
        tossed[head] = label[head] & 7
        label = tossed
    top = np.zeros(len(label), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    tail = np.r_[head[1:], True]
    top &= ~tail  # a row's last symbol starts no phrase of its own
    top |= head
    start = np.flatnonzero(top)
    out = X.segment_hashes(symbol, start, np.r_[start[1:], len(symbol)])
    return out, np.searchsorted(at[start], first)


def fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, BINS) of 16 bits; 0 where a range has no name."""
    n_rows = len(offs) - 1
    least = np.full(n_rows * BINS, np.iinfo(np.uint64).max, np.uint64)
    names, first, rows, level = X.byte_codes(21)[data], offs, np.arange(n_rows), 0
    while len(names):
        level += 1
        names, first = parse(names, first)
        count = np.diff(first)
        h = X.mix(names, level)
        np.minimum.at(least, np.repeat(rows, count) * BINS + (h >> np.uint64(58)).astype(np.int64), h)
        further = count > 1  # a text goes on while it is several phrases, whatever texts are beside it
        names = names[np.repeat(further, count)]
        rows, first = rows[further], np.r_[0, np.cumsum(count[further])]
    kept = ((least >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16)
    kept = np.where(least == np.iinfo(np.uint64).max, 0, np.maximum(kept, 1))
    return kept.astype(np.uint16).reshape(n_rows, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal ranges among those that either has: an estimate of the Jaccard similarity of the names."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(either > 0, equal / np.maximum(either, 1), 1.0)


def _hex(prints: np.ndarray) -> list[str]:
    raw, width = prints.astype(">u2").tobytes().hex(), 4 * BINS
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def fingerprint_columns(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fingerprints of a text column, block by block."""
    parts = [fingerprints(data, offs) for _, _, data, offs in X.blocks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, BINS), np.uint16)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _chars(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all code points (and the end), and each row's first code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return np.r_[at, len(data)], np.searchsorted(at, offs)


def _edited_block(table: pa.Table) -> pa.Table:
    """Rows of one block (next = 0) with the rows that may follow its last one (next = 1)."""
    table = table.combine_chunks().sort_by([("next", "ascending"), ("doc_id", "descending"), ("text", "ascending")])
    own = int((table.column("next").to_numpy() == 0).sum())
    data, offs = X.flat(table.column("text"))
    ids = table.column("doc_id").slice(0, own)
    has = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool)
    n_ids = int(has.sum())
    prints = fingerprint_columns(table.column("text"))
    at, first = _chars(data, offs)
    n_chars = np.diff(first)
    follow = np.arange(1, own + 1)
    if n_ids:
        follow[n_ids - 1] = own if table.num_rows > own else n_ids - 1
    raw, empty, texts, sums = data.tobytes(), np.zeros((1, BINS), np.uint16), [], []
    for i in range(own):
        take = int(n_chars[i]) // 2
        text = raw[offs[i] : at[first[i] + int(n_chars[i]) - take]]
        if has[i]:
            j = follow[i]
            text += raw[offs[j] : at[first[j] + min(take, int(n_chars[j]))]]
        texts.append(text)
        sums.append(hashlib.sha256(text).hexdigest())
    edited = fingerprint_columns(pa.array(texts, pa.binary()))
    after = np.concatenate([prints, empty])[np.where(has, follow, len(prints))] if own else prints[:0]
    mine = prints[:own]
    return pa.table([ids, pa.array(n_chars[:own], pa.int64()), pa.array(sums, pa.string()), pa.array(_hex(mine), pa.string()), pa.array(_hex(edited), pa.string()), pa.array(likeness(mine, edited)), pa.array(likeness(mine, after))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _without_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from _edited_block(pa.Table.from_batches([batch])).combine_chunks().to_batches()


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs``: 256 hex digits; equal texts have equal ones.

    Null and empty texts have the fingerprint of zeros. Rows that repeat a doc_id and rows without
    doc_id get one each. Other columns are not looked at.
    """

    def run(batches):
        for batch in batches:
            for a, b, data, offs in X.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_hex(fingerprints(data, offs)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text; one row per row of ``docs``.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document by descending doc_id; after the last comes the first. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness to
    the edited text's and to the next document's fingerprint; 1 for two empty texts).

    Null texts are empty. Rows that repeat a doc_id follow each other in the order of their texts.
    A single document is its own next. Rows without doc_id have no next: their last half is cut off.
    No rows give no rows. Other columns are not looked at.
    """
    rows, n_blocks, _ = B.deal(docs)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    heads = rows.where("doc_id is not null").groupBy("blk").agg(F.max("doc_id").alias("head"))
    lower = F.lag("head").over(W.orderBy("blk"))
    top = heads.agg(F.max("head").alias("top"))
    follow = heads.select(F.col("blk").alias("to"), lower.alias("lower")).join(F.broadcast(top)).select("to", F.coalesce("lower", "top").alias("id"))
    follow = F.broadcast(follow) if n_blocks <= BROADCAST_BLOCKS else follow
    extra = rows.join(follow, rows["doc_id"] == follow["id"]).groupBy("to", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("to").alias("blk"), F.lit(1).alias("next"))
    both = rows.select("doc_id", "text", "blk", F.lit(0).alias("next")).unionByName(extra)
    alone = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(0).alias("next"))
    return both.groupBy("blk").applyInArrow(_edited_block, _OUT).unionByName(alone.mapInArrow(_without_id, _OUT))
