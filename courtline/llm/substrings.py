"""Suffix-array dedup of byte strings over all documents.

A string of ``SPAN`` bytes is found through its anchor: the ``GRAM``-byte piece in it with
the least hash. Equal strings have equal anchors wherever they stand, so

1. anchors that two documents share are found by their hashes (one entry per block); one
   that stands at more than about ``HOT`` places is hot,
2. the surroundings of shared anchors (the anchor and ``REACH`` bytes on either side, which
   holds every string with that anchor) go to the anchor's bucket, each distinct one once
   per block with its first document,
3. a bucket merges equal surroundings; those that differ around one anchor are put into a
   generalised suffix array by the grouping construction, neighbours in it that agree in
   ``SPAN`` bytes are the same string, and the first document of each string is known,
4. around a hot anchor each string goes to the string's own bucket, once per block, so that
   what differs around the borders of a common passage is dealt over all buckets,
5. blocks mark what those strings cover.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocked as B
from . import textarrays as X
from .suffixes import suffix_array

#: Length of a string, of an anchor, and of what surrounds one.
SPAN, GRAM = 50, 26
REACH = SPAN - GRAM
WIDTH, STARTS = SPAN + REACH, REACH + 1
NONE = 0xFF  # stands for what is outside a document; it is no byte of UTF-8
ANCHORS_PER_BUCKET, ROWS_PER_ARRAY = 1 << 20, 4096
#: Places of an anchor, at most, whose surroundings are sorted in one task.
HOT = 1 << 13
_ENTRY = WIDTH + 4


def _anchors(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor (first start, end), the anchors' starts and hashes.

    Of equal least hashes in a string the leftmost counts, so the text of a string alone decides.
    """
    h = X.window_hashes(codes, GRAM)
    n = len(h) - REACH
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least, size = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= STARTS:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    least = np.minimum(least[:n], least[STARTS - size : STARTS - size + n])
    inside = np.ones(n, bool)
    for end in offs[1:].tolist():
        inside[max(0, end - SPAN + 1) : end] = False
    change = inside.copy()
    change[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    begin, stop = np.flatnonzero(change), np.r_[np.flatnonzero(change | ~inside), n]
    end = stop[np.searchsorted(stop, begin, side="right")]
    at = (least[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return begin, end, at, h[at]


def _block(table: pa.Table, n_buckets: int):
    """Of a block: rows by id, per part its runs, distinct anchor keys, which are in several documents, how many places each has."""
    table, ids, has = B.ordered(table)
    table_codes, parts, keys, docs = X.byte_codes(5), [], [], []
    for a, b, data, offs in X.blocks(table.column("text")):
        begin, end, at, h = _anchors(table_codes[data], offs)
        row = np.searchsorted(offs, begin, side="right") - 1
        if not has[a:b].all():
            ok = has[a + row]
            begin, end, at, h, row = begin[ok], end[ok], at[ok], h[ok], row[ok]
        key = (B.bucket_of(h, n_buckets).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        parts.append((a, b, data, offs, begin, end, at, row, key))
        keys.append(key)
        docs.append(ids[a + row])
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    docs = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")  # rows are in id order, so the ids of a key ascend
    keys, docs = keys[order], docs[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(keys)] - 1 if len(new) else new
    place, done = np.empty(len(keys), np.int64), 0
    place[order] = np.repeat(np.arange(len(new)), last - new + 1)
    for k, part in enumerate(parts):  # each run with its key's place among the distinct ones
        parts[k] = (*part, place[done : done + len(part[-1])])
        done += len(part[-1])
    return table, ids, has, parts, keys[new], docs[new] != docs[last], last - new + 1


def _ask_anchors(n_buckets: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        *_, uniq, several, places = _block(table, n_buckets)
        low = uniq.astype(np.uint32)
        level = np.ceil(np.log2(places)).astype(np.uint8) | several.astype(np.uint8) << 7
        return B.asks(B.key_of(key), (uniq >> np.uint64(32)).astype(np.int64), lambda a, b: low[a:b].tobytes() + level[a:b].tobytes())

    return ask


def _answer_anchors(hot: int):
    """For each asked anchor two bits: is it in two documents, and is it at more than ``hot`` places (rounded up to powers of two in a block)?"""

    def answer(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x, np.uint8) for x in table.column("payload").to_pylist()]
        sizes = [len(x) // 5 for x in raw]
        low = np.concatenate([x[: 4 * n].view(np.uint32) for x, n in zip(raw, sizes, strict=True)])
        level = np.concatenate([x[4 * n :] for x, n in zip(raw, sizes, strict=True)])
        _, inverse, counts = np.unique(low, return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[inverse[level >= 128]] = True
        many = np.bincount(inverse, weights=np.exp2(level & 127), minlength=len(counts)) > hot
        bits, ends = np.stack([shared, shared & many], axis=1)[inverse], np.cumsum(sizes)
        return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array([B.packed(bits[e - n : e]) for n, e in zip(sizes, ends, strict=True)], pa.binary()))

    return answer


def _surroundings(block, bits: np.ndarray, n_buckets: int):
    """Per part its shared anchors that are not hot; for the block the distinct surroundings, their buckets and first documents."""
    table, ids, has, parts, *_ = block
    found, rows, buckets, docs = [], [np.zeros((0, WIDTH), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, data, offs, begin, end, at, row, key, place in parts:
        shared = np.flatnonzero((bits[:, 0] & ~bits[:, 1])[place])
        begin, end, at, row, key = begin[shared], end[shared], at[shared], row[shared], key[shared]
        edge = np.full(REACH, NONE, np.uint8)
        around = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, data, edge]), WIDTH)[at] if len(at) else rows[0].copy()
        for k in np.flatnonzero((at - REACH < offs[row]) | (at + SPAN > offs[row + 1])).tolist():
            around[k, : max(0, REACH - int(at[k] - offs[row[k]]))] = NONE
            around[k, REACH + int(offs[row[k] + 1] - at[k]) :] = NONE
        found.append((begin, end, at))
        rows.append(around)
        buckets.append(((key >> np.uint64(32)).astype(np.int64) * 2654435761 + (key & np.uint64(0xFFFFFFFF)).astype(np.int64)) % n_buckets)
        docs.append(ids[a + row])
    rows, buckets, docs = np.concatenate(rows), np.concatenate(buckets), np.concatenate(docs)
    name = np.zeros(len(rows), np.uint64)
    codes = X.byte_codes(6)
    for k in range(WIDTH):
        name = name * np.uint64(0x9E3779B97F4A7C15) + codes[rows[:, k]]
    first, inverse = B.distinct(buckets, X.mix(name))
    return found, rows[first], buckets[first], docs[first], docs, inverse


def _steps(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [begin, end), one range after the other."""
    size = end - begin
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def _hot_strings(block, bits: np.ndarray, n_hot: int):
    """Per part the starts of strings with a hot anchor; for the block the distinct ones' part, start, bucket and first row, and all rows."""
    parts = block[3]
    found, hashes, rows, of = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    codes = X.byte_codes(7)
    for k, (a, b, data, offs, begin, end, at, row, _, place) in enumerate(parts):
        hot = np.flatnonzero(bits[:, 1][place])
        start = _steps(begin[hot], end[hot]).astype(np.int32)
        found.append(start)
        if len(start):
            hashes.append(X.segment_hashes(codes[data], start, start + SPAN))
            rows.append((a + np.repeat(row[hot], end[hot] - begin[hot])).astype(np.int32))
            of.append(np.full(len(start), k, np.int32))
    h, rows, of = np.concatenate(hashes), np.concatenate(rows), np.concatenate(of)
    start = np.concatenate([np.zeros(0, np.int32), *found])
    bucket = B.bucket_of(h, n_hot)
    first, inverse = B.distinct(bucket, h)
    return found, of[first], start[first], bucket[first], rows[first], rows, inverse


def _ask_strings(n_anchor: int, n_text: int, n_hot: int):
    """Asks about surroundings (buckets up to ``n_text``) and about the strings around hot anchors (buckets after those)."""

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = _block(left, n_anchor)
        bits = B.answers(right, 2 * len(block[4])).reshape(-1, 2)
        _, rows, bucket, docs, *_ = _surroundings(block, bits, n_text)
        rank = np.unique(docs, return_inverse=True)[1].astype(np.int32)
        cold = B.asks(B.key_of(key), bucket, lambda a, b: np.int32(b - a).tobytes() + pa.compress(rows[a:b].tobytes() + rank[a:b].tobytes(), codec="zstd", asbytes=True))
        del rows, docs, rank
        _, of, start, bucket, *_ = _hot_strings(block, bits, n_hot)

        def payload(a: int, b: int) -> bytes:
            text = np.zeros((b - a, SPAN), np.uint8)
            for k in np.unique(of[a:b]).tolist():
                here = of[a:b] == k
                text[here] = np.lib.stride_tricks.sliding_window_view(block[3][k][2], SPAN)[start[a:b][here]]
            return np.int32(b - a).tobytes() + pa.compress(text.tobytes(), codec="zstd", asbytes=True)

        return pa.concat_tables([cold, B.asks(B.key_of(key), n_text + bucket, payload)])

    return ask


def _trim(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Surroundings without the bytes that no other one of their group (anchor) agrees in.

    A string that two surroundings share lies inside what is left of both.
    """
    rows, name = rows.copy(), np.ascontiguousarray(group.astype(">u4")).view(np.uint8).reshape(-1, 4)
    for left in (True, False):
        part = rows[:, REACH - 1 :: -1] if left else rows[:, SPAN:]
        part = np.ascontiguousarray(np.concatenate([name, part], axis=1))
        order = np.argsort(part.view(f"S{REACH + 4}").reshape(-1), kind="stable")
        part = part[order]
        same = np.cumprod(part[1:] == part[:-1], axis=1, dtype=np.int8).sum(axis=1) - 4
        most = np.zeros(len(rows), np.int64)
        most[order] = np.maximum(0, np.maximum(np.r_[same, 0], np.r_[0, same]))
        gone = np.arange(REACH)[None, :] >= most[:, None]
        if left:
            rows[:, :REACH][gone[:, ::-1]] = NONE
        else:
            rows[:, SPAN:][gone] = NONE
    return rows


def _whole(rows: np.ndarray) -> np.ndarray:
    """(rows, STARTS): does a whole string start there?"""
    gaps = np.cumsum(np.concatenate([np.zeros((len(rows), 1), np.uint8), rows == NONE], axis=1), axis=1, dtype=np.uint8)
    return gaps[:, SPAN:] == gaps[:, :STARTS]


def _first_of_strings(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """(rows, STARTS): the least order of any row that holds the string that starts there (by suffix array)."""
    out = np.full((len(rows), STARTS), np.iinfo(np.int64).max)
    text = np.concatenate([np.zeros((len(rows), 1), np.int64), rows.astype(np.int64) + 1], axis=1)
    place = np.flatnonzero(text <= NONE)  # each row's own bytes behind a zero
    sa = suffix_array(np.r_[text.reshape(-1)[place], 0])[0]
    row, col = np.divmod(place[sa[sa < len(place)]], WIDTH + 1)
    col -= 1
    ok = (col >= 0) & (col < STARTS) & _whole(rows)[row, np.clip(col, 0, REACH)]
    row, col = row[ok], col[ok]
    if not len(row):
        return out
    strings = np.lib.stride_tricks.sliding_window_view(rows, SPAN, axis=1)
    new = np.ones(len(row), bool)
    for a in range(1, len(row), 1 << 16):
        b = min(len(row), a + (1 << 16))
        new[a:b] = (strings[row[a:b], col[a:b]] != strings[row[a - 1 : b - 1], col[a - 1 : b - 1]]).any(axis=1)
    at = np.flatnonzero(new)
    out[row, col] = np.minimum.reduceat(order[row], at)[np.cumsum(new) - 1]
    return out


def answer_strings(table: pa.Table) -> pa.Table:
    """For each asked surrounding 25 bits: does the string that starts there start in a smaller document, too?"""
    sizes, rows, order = [], [], []
    for blk, x in zip(table.column("blk").to_pylist(), table.column("payload").to_pylist(), strict=True):
        n = int(np.frombuffer(x, np.int32, 1)[0])
        raw = np.frombuffer(pa.decompress(x[4:], n * _ENTRY, codec="zstd", asbytes=True), np.uint8)
        rows.append(raw[: n * WIDTH].reshape(n, WIDTH))
        order.append((blk << 32) | raw[n * WIDTH :].view(np.int32).astype(np.int64))
        sizes.append(n)
    rows, order = np.concatenate(rows), np.concatenate(order)
    _, at, which = np.unique(rows.view(f"V{WIDTH}").reshape(-1).view(f"S{WIDTH}"), return_index=True, return_inverse=True)
    least = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(least, which, order)
    own = rows[at]
    first = np.repeat(least[:, None], STARTS, axis=1)
    mid = np.unique(np.ascontiguousarray(own[:, REACH:SPAN]).view(f"S{GRAM}").reshape(-1), return_inverse=True)[1]
    group = np.flatnonzero(np.bincount(mid)[mid] > 1)
    if len(group):
        text, pick, back = np.unique(_trim(own[group], mid[group]).view(f"V{WIDTH}").reshape(-1).view(f"S{WIDTH}"), return_index=True, return_inverse=True)
        text = np.frombuffer(text.tobytes(), np.uint8).reshape(len(pick), WIDTH)
        least_of = np.full(len(pick), np.iinfo(np.int64).max)
        np.minimum.at(least_of, back, least[group])
        found = np.full((len(pick), STARTS), np.iinfo(np.int64).max)
        anchor = mid[group][pick]
        by = np.argsort(anchor, kind="stable")
        whole = _whole(text)
        by = by[whole[by].any(axis=1)]
        alone = by[np.bincount(anchor[by], minlength=len(mid))[anchor[by]] == 1]  # all that its anchor's rows share is one text
        found[alone] = np.where(whole[alone], least_of[alone, None], found[alone])
        by = by[np.bincount(anchor[by], minlength=len(mid))[anchor[by]] > 1]
        edges = np.flatnonzero(np.r_[True, anchor[by][1:] != anchor[by][:-1], True]) if len(by) else np.zeros(1, np.int64)
        a = 0
        while a < len(edges) - 1:  # whole anchors, up to about ROWS_PER_ARRAY rows
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + ROWS_PER_ARRAY, side="right")) - 1)
            part = by[edges[a] : edges[b]]
            found[part] = _first_of_strings(text[part], least_of[part])
            a = b
        first[group] = np.minimum(first[group], found[back])
    bits = (first[which] < order[:, None]).astype(np.uint32)
    bits = (bits << np.arange(STARTS, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    ends = np.cumsum(sizes)
    return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array([bits[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)], pa.binary()))


def answer_hot(table: pa.Table) -> pa.Table:
    """For each asked string of a bucket: does an earlier block ask about it, too?"""
    sizes, text = [], []
    for x in table.column("payload").to_pylist():
        sizes.append(int(np.frombuffer(x, np.int32, 1)[0]))
        text.append(np.frombuffer(pa.decompress(x[4:], sizes[-1] * SPAN, codec="zstd", asbytes=True), f"S{SPAN}"))
    blk = np.repeat(table.column("blk").to_numpy(), sizes)
    _, at, which = np.unique(np.concatenate(text), return_index=True, return_inverse=True)
    least = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(least, which, blk)
    bits, ends = least[which] < blk, np.cumsum(sizes)
    return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array([B.packed(bits[e - n : e]) for n, e in zip(sizes, ends, strict=True)], pa.binary()))


def _answer(n_text: int):
    def answer(key: tuple, table: pa.Table) -> pa.Table:
        return answer_strings(table) if B.key_of(key) < n_text else answer_hot(table)

    return answer


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept {kept}, crc long"


def _remove(n_anchor: int, n_text: int, n_hot: int, as_text: bool):
    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rounds = right.column("round").to_numpy()
        block = _block(left, n_anchor)
        shared = B.answers(right.filter(pa.array(rounds == 1)), 2 * len(block[4])).reshape(-1, 2)
        found, _, _, least, docs, inverse = _surroundings(block, shared, n_text)
        hot, _, _, _, first_row, row_of, place = _hot_strings(block, shared, n_hot)
        is_hot = right.column("bucket").to_numpy() >= n_text
        earlier = B.answers(right.filter(pa.array((rounds == 2) & is_hot)), len(first_row))
        gone_hot = earlier[place] | (block[1][row_of] > block[1][first_row][place])
        second = right.filter(pa.array((rounds == 2) & ~is_hot)).sort_by([("bucket", "ascending")])
        bits = np.frombuffer(b"".join(second.column("payload").to_pylist()), np.uint32)
        if len(bits) != len(least):
            raise ValueError(f"{len(least)} surroundings were asked and {len(bits)} answered")
        table, ids, has, parts = block[:4]
        size, removed, spans, kept, crc, done, done_hot = [], [], [], [], [], 0, 0
        for (a, b, data, offs, *_), (begin, end, at), hot_start in zip(parts, found, hot, strict=True):
            entry, doc = inverse[done : done + len(at)], docs[done : done + len(at)]
            done += len(at)
            cut = np.zeros(len(data), bool)
            if len(at):
                size_of = end - begin
                start = _steps(begin, end)
                shift = (start - np.repeat(at, size_of) + REACH).astype(np.uint32)
                gone = ((np.repeat(bits[entry], size_of) >> shift) & np.uint32(1)).astype(bool) | np.repeat(doc > least[entry], size_of)
                cut = X.cover(start[gone], SPAN, len(data))
            if len(hot_start):
                cut |= X.cover(hot_start[gone_hot[done_hot : done_hot + len(hot_start)]], SPAN, len(data))
                done_hot += len(hot_start)
            total = np.r_[0, np.cumsum(cut)]
            run = X.runs(cut, offs)[0] if cut.any() else np.zeros(0, np.int64)
            size.append(np.diff(offs))
            removed.append(np.diff(total[offs]))
            spans.append(np.diff(np.searchsorted(run, offs)))
            raw, to = data[~cut].tobytes(), offs - total[offs]
            kept += [raw[i:j] for i, j in zip(to[:-1], to[1:], strict=True)]
            whole = data.tobytes()
            crc += [zlib.crc32(whole[i:j]) for i, j in zip(offs[:-1], offs[1:], strict=True)]
        number = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~has), "n_bytes": number(size), "n_removed": number(removed), "n_spans": number(spans), "kept": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), "crc": pa.array(crc, pa.int64())})

    return remove


def remove_repeated_strings(docs: DataFrame, as_text: bool = False, hot: int = HOT) -> DataFrame:
    """Remove every byte that a repeated 50-byte string covers; one row per row of ``docs``.

    Texts are UTF-8 bytes; a string is repeated if it also starts in a document with a
    smaller doc_id. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the
    bytes that stay; with ``as_text`` a string without the characters that a cut went through)
    and crc (CRC-32 of the text that came in).

    Null and empty texts have no bytes. Rows that repeat a doc_id are judged alike and never
    remove each other; rows without doc_id are kept whole and remove nothing. Texts under 50
    bytes lose nothing. An empty table gives an empty table. Other columns are not looked at.
    ``hot`` bounds the places of an anchor that one task sorts; it doesn't change the result.
    """
    rows, _, size = B.deal(docs)
    n_anchor = max(16, size // 13 // ANCHORS_PER_BUCKET * 2)
    n_text, n_hot = max(16, size // (24 << 20)), max(16, size // (8 << 20))
    by = rows.groupBy("blk")
    shared = by.applyInArrow(_ask_anchors(n_anchor), B.ASK).groupBy("bucket").applyInArrow(_answer_anchors(hot), B.ASK)
    strings = by.cogroup(shared.groupBy("blk")).applyInArrow(_ask_strings(n_anchor, n_text, n_hot), B.ASK).groupBy("bucket").applyInArrow(_answer(n_text), B.ASK)
    both = shared.withColumn("round", F.lit(1)).unionByName(strings.withColumn("round", F.lit(2)))
    out = by.cogroup(both.groupBy("blk")).applyInArrow(_remove(n_anchor, n_text, n_hot, as_text), OUT.format(kept="string" if as_text else "binary"))
    whole = docs.where("doc_id is null").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("kept"))
    n_bytes, none = F.octet_length("kept").cast("long"), F.lit(0).cast("long")
    return out.unionByName(whole.select(none.alias("doc_id"), n_bytes.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("kept").cast("string" if as_text else "binary"), F.crc32(F.col("kept").cast("binary")).alias("crc")).withColumn("doc_id", F.lit(None).cast("long")))
