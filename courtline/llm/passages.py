"""Substring dedup by difference-cover anchors.

Windows of ``span - period + 1`` words are hashed only where the word's index modulo
``period`` is in a difference cover. Two equal runs of ``span`` words, at any two
offsets, have some shift at which both indexes are in the cover, so they share an
aligned anchor. Anchors found in more than one document mark the only places where a
repeat can be; there the match is extended to whole windows of ``span`` words, which are
compared by 96-bit hashes over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocked as B
from . import textarrays as X

#: A perfect difference set modulo 7.
PERIOD, COVER = 7, (0, 1, 3)
ANCHORS_PER_BUCKET = 1 << 20


def _parts(table: pa.Table):
    for a, b, data, offs in X.blocks(table.column("text")):
        starts, ends, first = X.words(data, offs, X.NOT_SPACE)
        yield a, b, data, offs, starts, ends, first


def _anchors(codes: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes of anchors and their hashes."""
    k = span - PERIOD + 1
    index = np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))
    at = np.flatnonzero(np.isin(index % PERIOD, COVER) & X.window_rows(first, k))
    return at, X.segment_hashes(codes, at, at + k) if len(at) else np.zeros(0, np.uint64)


def _short(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket and 32 bits of an anchor in one number; a clash only makes a place be looked at."""
    return (B.bucket_of(h, n).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _block(table: pa.Table, span: int, n_buckets: int):
    """Of a block: rows by id, per part its words and anchors, distinct anchor keys, which are in several documents."""
    table, ids, has = B.ordered(table)
    codes8, parts, keys, docs = X.byte_codes(8), [], [], []
    for a, b, data, offs, starts, ends, first in _parts(table):
        codes = X.segment_hashes(codes8[data], starts, ends)
        at, h = _anchors(codes, first, span)
        row = a + np.searchsorted(first, at, side="right") - 1
        keep = has[row]
        at, h, row = at[keep], h[keep], row[keep]
        key = _short(h, n_buckets)
        parts.append((a, b, data, offs, starts, ends, first, codes, at, key))
        keys.append(key)
        docs.append(ids[row])
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    docs = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")  # rows are in id order, so the ids of a key ascend
    keys, docs = keys[order], docs[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(keys)] - 1 if len(new) else new
    place, done = np.empty(len(keys), np.int64), 0
    place[order] = np.repeat(np.arange(len(new)), last - new + 1)
    for k, part in enumerate(parts):  # each anchor with its key's place among the distinct ones
        parts[k] = (*part[:-1], place[done : done + len(part[-1])])
        done += len(part[-1])
    return table, ids, has, parts, keys[new], docs[new] != docs[last]


def _ask_anchors(span: int, n_buckets: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        *_, uniq, several = _block(table, span, n_buckets)
        low = uniq.astype(np.uint32)
        return B.asks(B.key_of(key), (uniq >> np.uint64(32)).astype(np.int64), lambda a, b: low[a:b].tobytes() + several[a:b].tobytes())

    return ask


def answer_shared(table: pa.Table) -> pa.Table:
    """For each asked 32-bit key of a bucket: is it asked by two blocks, or in two documents of one?"""
    raw = [np.frombuffer(x, np.uint8) for x in table.column("payload").to_pylist()]
    sizes = [len(x) // 5 for x in raw]
    low = np.concatenate([x[: 4 * n].view(np.uint32) for x, n in zip(raw, sizes, strict=True)])
    several = np.concatenate([x[4 * n :] for x, n in zip(raw, sizes, strict=True)]).astype(bool)
    _, inverse, counts = np.unique(low, return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[inverse[several]] = True
    bits, ends = shared[inverse], np.cumsum(sizes)
    return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array([B.packed(bits[e - n : e]) for n, e in zip(sizes, ends, strict=True)], pa.binary()))


def _candidates(block, bits: np.ndarray, span: int, n_buckets: int):
    """Per part the starts of windows that hold a shared anchor, with both hashes; then the block's distinct windows."""
    table, ids, has, parts, *_ = block
    k, second, found = span - PERIOD + 1, X.byte_codes(9), []
    for a, b, data, offs, starts, ends, first, codes, at, place in parts:
        n = len(starts)
        hot = np.zeros(n + 1, np.int32)
        hit = at[bits[place]]
        hot[hit + 1] = 1
        total = np.cumsum(hot)
        start = np.flatnonzero(X.window_rows(first, span))
        start = start[total[np.minimum(start + span - k + 1, n)] > total[start]]
        row = a + np.searchsorted(first, start, side="right") - 1
        start, row = start[has[row]], row[has[row]]
        h = X.segment_hashes(codes, start, start + span)
        other = X.segment_hashes(X.segment_hashes(second[data], starts, ends), start, start + span) if len(start) else h
        found.append((start, row, h, other))
    h = np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.uint64)
    other = np.concatenate([x[3] for x in found]) if found else h
    doc = ids[np.concatenate([x[1] for x in found])] if found else np.zeros(0, np.int64)
    first_at, inverse = B.distinct(B.bucket_of(h, n_buckets), h)
    return found, h[first_at], other[first_at].astype(np.uint32), doc[first_at], doc, inverse


def _ask_windows(span: int, n_anchor: int, n_window: int):
    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = _block(left, span, n_anchor)
        bits = B.answers(right, len(block[4]))
        _, h, other, *_ = _candidates(block, bits, span, n_window)
        return B.asks(B.key_of(key), B.bucket_of(h, n_window), lambda a, b: h[a:b].tobytes() + other[a:b].tobytes())

    return ask


def answer_earlier(table: pa.Table) -> pa.Table:
    """For each asked window of a bucket: does an earlier block ask about it, too?"""
    raw = [np.frombuffer(x, np.uint8) for x in table.column("payload").to_pylist()]
    sizes = [len(x) // 12 for x in raw]
    h = np.concatenate([x[: 8 * n].view(np.uint64) for x, n in zip(raw, sizes, strict=True)])
    other = np.concatenate([x[8 * n :].view(np.uint32) for x, n in zip(raw, sizes, strict=True)])
    blk = np.repeat(table.column("blk").to_numpy(), sizes)
    order = np.lexsort((blk, other, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])]
    least = blk[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    bits = np.empty(len(h), bool)
    bits[order] = least < blk[order]
    ends = np.cumsum(sizes)
    return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array([B.packed(bits[e - n : e]) for n, e in zip(sizes, ends, strict=True)], pa.binary()))


OUT = "doc_id long, n_words long, n_removed long, kept string"


def _remove(span: int, n_anchor: int, n_window: int):
    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rounds = right.column("round").to_numpy()
        block = _block(left, span, n_anchor)
        bits = B.answers(right.filter(pa.array(rounds == 1)), len(block[4]))
        found, h, _, least, doc, inverse = _candidates(block, bits, span, n_window)
        earlier = B.answers(right.filter(pa.array(rounds == 2)), len(h))
        gone = earlier[inverse] | (doc > least[inverse])
        table, ids, has, parts = block[:4]
        out_words, out_removed, kept, done = [], [], [], 0
        for (a, b, data, offs, starts, ends, first, *_), (start, *_) in zip(parts, found, strict=True):
            here = gone[done : done + len(start)]
            done += len(start)
            cut = X.cover(start[here], span, len(starts))
            total = np.r_[0, np.cumsum(cut)]
            out_words.append(np.diff(first))
            out_removed.append(total[first[1:]] - total[first[:-1]])
            kept += joined(data, starts, ends, first, ~cut)
        number = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~has), "n_words": number(out_words), "n_removed": number(out_removed), "kept": pa.array(kept, pa.string())})

    return remove


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without id, of which nothing is removed."""
    for batch in batches:
        for a, b, data, offs in X.blocks(batch.column(0)):
            starts, ends, first = X.words(data, offs, X.NOT_SPACE)
            kept = pa.array(joined(data, starts, ends, first, np.ones(len(starts), bool)), pa.string())
            yield pa.RecordBatch.from_arrays([pa.nulls(b - a, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(np.zeros(b - a, np.int64)), kept], names=["doc_id", "n_words", "n_removed", "kept"])


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """For each row its kept words, joined by one space."""
    length = np.where(keep, ends - starts + 1, 0)
    at = np.r_[0, np.cumsum(length)]
    flag = np.zeros(len(data) + 1, np.int8)
    np.add.at(flag, starts[keep], 1)
    np.add.at(flag, ends[keep], -1)
    inside = np.cumsum(flag[:-1]).astype(bool)
    out = np.full(int(at[-1]), 0x20, np.uint8)
    hole = np.ones(len(out), bool)
    hole[at[1:][keep] - 1] = False
    out[hole] = data[inside]
    raw = out.tobytes()
    return [raw[at[i] : max(at[i], at[j] - 1)] for i, j in zip(first[:-1], first[1:], strict=True)]


def remove_repeated_passages(docs: DataFrame, span: int = 13) -> DataFrame:
    """Remove every word that a repeated window covers; one row per row of ``docs``.

    A word is a run of bytes other than ASCII white space. A window of ``span`` words of a
    document is repeated if its word sequence also starts in a document with a smaller
    doc_id. Returns doc_id, n_words, n_removed and kept (the kept words joined by one space).

    Null and empty texts have no words. Rows that repeat a doc_id are judged alike and never
    remove each other; rows without doc_id are kept whole and remove nothing. Texts of fewer
    than ``span`` words lose nothing. An empty table gives an empty table. Other columns are
    not looked at.
    """
    if span < PERIOD:
        raise ValueError(f"span must be {PERIOD} words at least")
    rows, _, size = B.deal(docs)
    n_anchor = max(16, size // 15 // ANCHORS_PER_BUCKET * 4)
    n_window = max(16, size // 20 // ANCHORS_PER_BUCKET * 4)
    by = rows.groupBy("blk")
    shared = by.applyInArrow(_ask_anchors(span, n_anchor), B.ASK).groupBy("bucket").applyInArrow(answer_shared, B.ASK)
    earlier = by.cogroup(shared.groupBy("blk")).applyInArrow(_ask_windows(span, n_anchor, n_window), B.ASK).groupBy("bucket").applyInArrow(answer_earlier, B.ASK)
    both = shared.withColumn("round", F.lit(1)).unionByName(earlier.withColumn("round", F.lit(2)))
    out = by.cogroup(both.groupBy("blk")).applyInArrow(_remove(span, n_anchor, n_window), OUT)
    return out.unionByName(docs.where("doc_id is null").select(F.col("text").cast("string")).mapInArrow(_whole, OUT))
