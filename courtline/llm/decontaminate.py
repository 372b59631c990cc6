"""Benchmark decontamination with suffix arrays over shards of the documents.

Each block of documents is a shard with a suffix array of its words, sorted to the full depth
of its repeats; words that the benchmark doesn't have end a suffix, as no match can go past one.
Every suffix of every benchmark item is searched in it by binary search, word after word, to its
longest verbatim match and all places of that; on the way the places of its window are met.
Matches are told from where they begin on the left to where they end on the right. A shard
is searched where it is read, so documents are never shuffled. The benchmark is sent out in
blocks of about ``ITEM_BYTES`` of text; each block is searched in every shard. Where there is
more than one block, each has a scan of its own, so that a task holds one block whatever the
size of the benchmark, and what a document has of each is put together by its key.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as X

ITEM_BYTES, AT_ONCE = 16 << 20, 1 << 20
MATCH = "struct<item_id: string, doc_word: long, item_word: long, n_words: long>"
RUN = "struct<a: long, b: long>"
OUT = f"doc_id long, n_words long, n_hit long, items array<string>, matches array<{MATCH}>"


def _word_codes(column: pa.Array, a: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and each row's first word."""
    data, offs = X.flat(column)
    return _codes(data, offs)


def _codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = X.LOWER[data]
    starts, ends, first = X.words(data, offs, X.ALNUM)
    return X.segment_hashes(X.byte_codes(2)[data], starts, ends), first


def item_block(ids: list[str | None], texts: list[str | None], span: int) -> dict:
    """Vocabulary and numbered words of one block of items, ready to be searched for."""
    codes, first = _word_codes(pa.array(texts, pa.string()))
    vocabulary, number = np.unique(codes, return_inverse=True)
    length = np.diff(first)
    item = np.repeat(np.arange(len(ids)), length)
    return {"ids": pa.array(["" if x is None else str(x) for x in ids], pa.string()), "vocabulary": vocabulary, "number": number.astype(np.int64) + 1, "first": first, "item": item, "end": first[1:][item], "window": np.minimum(span, length)[item]}


def suffix_order(number: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places of all known words (number > 0) in suffix order; a suffix goes to ``end`` of its place, and a shorter one that is equal so far comes first."""
    n = len(number)
    order = np.flatnonzero(number > 0)
    order = order[np.argsort(number[order], kind="stable")]
    rank, key, among, k = np.zeros(n + 1, np.int64), number[order], np.arange(len(order)), 1
    while len(among):  # doubles the depth of those that are not alone
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        rank[order[among]] = 1 + np.repeat(among[start], size)
        among = among[np.repeat(size > 1, size)]
        at = order[among]
        key = rank[at] * (n + 2) + np.where(at + k < end[at], rank[np.minimum(at + k, n)], 0)
        by = np.argsort(key)
        order[among], key = at[by], key[by]
        more = key % (n + 2) > 0  # the others ended together: they are equal, and the first of their group
        among, key, k = among[more], key[more], 2 * k
    return order


def _narrowed(low: np.ndarray, high: np.ndarray, word, want: np.ndarray, right: bool) -> np.ndarray:
    """First place in [low, high) whose word is not less than (with ``right``: is above) the wanted one, by binary search."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while live.size:
        mid = (low[live] + high[live]) >> 1
        v = word(mid)
        up = v <= want[live] if right else v < want[live]
        low[live[up]] = mid[up] + 1
        high[live[~up]] = mid[~up]
        live = live[low[live] < high[live]]
    return low


def search_suffixes(number: np.ndarray, end: np.ndarray, order: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each item suffix's longest match in words, and its places order[low:high]; then those of its window (none: low = high).

    A window counts from the suffixes that have at least so many words.
    """
    query, stop, window = block["number"], block["end"], block["window"]
    m, n = len(query), len(number)
    words = number[order]
    low, high = np.searchsorted(words, query), np.searchsorted(words, query, side="right")
    length = (high > low).astype(np.int64)
    here_low, here_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    live, depth = np.flatnonzero(high > low), 1
    while live.size:
        full = live[window[live] == depth]
        here_low[full], here_high[full] = low[full], high[full]
        live = live[live + depth < stop[live]]

        def word(place: np.ndarray, depth: int = depth) -> np.ndarray:
            at = order[place]
            return np.where(at + depth < end[at], number[np.minimum(at + depth, n - 1)], 0)

        want = query[live + depth]
        a = _narrowed(low[live], high[live], word, want, False)
        b = _narrowed(a, high[live], word, want, True)
        ok = b > a
        live = live[ok]
        low[live], high[live], length[live] = a[ok], b[ok], depth + 1
        depth += 1
    return length, low, high, here_low, here_high


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [low, high), one range after the other."""
    size = high - low
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def search_shard(codes: np.ndarray, first: np.ndarray, block: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of one shard: which words are hit; and for each row and item the longest verbatim match that has a window: row, item, start, in_item, n."""
    n, none = len(codes), np.zeros(0, np.int64)
    found = {k: none for k in ("row", "item", "start", "in_item", "n")}
    query, stop, vocabulary = block["number"], block["end"], block["vocabulary"]
    if not len(query) or not n:
        return np.zeros(n, bool), found
    known = np.searchsorted(vocabulary, codes)
    known[known == len(vocabulary)] = 0
    number = np.where(vocabulary[known] == codes, known + 1, 0)
    stops = np.unique(np.r_[np.flatnonzero(number == 0), first[1:]])
    end = stops[np.searchsorted(stops, np.arange(n), side="right")] if len(stops) else np.full(n, n)
    order = suffix_order(number, end)
    *_, low, high = search_suffixes(number, end, order, block)
    q = np.flatnonzero(high > low)
    _, one = np.unique(low[q] * (block["window"].max() + 1) + block["window"][q], return_index=True)  # a window once, however many items have it
    start = order[_ranges(low[q[one]], high[q[one]])]
    size = np.repeat(block["window"][q[one]], high[q[one]] - low[q[one]])
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
    hit = np.cumsum(edge[:n]) > 0
    many = np.cumsum(high[q] - low[q])
    a = 0
    while a < len(q):
        b = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + AT_ONCE, side="right")))
        i, at = np.repeat(q[a:b], high[q[a:b]] - low[q[a:b]]), order[_ranges(low[q[a:b]], high[q[a:b]])]
        row = np.searchsorted(first, at, side="right") - 1
        begins = (at == first[row]) | (i == block["first"][block["item"][i]]) | (number[at - 1] != query[i - 1])
        i, at, row = i[begins], at[begins], row[begins]
        size, live = block["window"][i].copy(), np.arange(len(i))
        while live.size:  # on to the right
            live = live[(at[live] + size[live] < end[at[live]]) & (i[live] + size[live] < stop[i[live]])]
            live = live[number[at[live] + size[live]] == query[i[live] + size[live]]]
            size[live] += 1
        item = block["item"][i]
        new = {"row": row, "item": item, "start": at, "in_item": i - block["first"][item], "n": size}
        found = {k: np.concatenate([found[k], v]) for k, v in new.items()}
        by = np.lexsort((found["in_item"], found["start"], -found["n"], found["item"], found["row"]))
        found = {k: v[by] for k, v in found.items()}
        longest = np.r_[True, (found["row"][1:] != found["row"][:-1]) | (found["item"][1:] != found["item"][:-1])] if len(by) else np.zeros(0, bool)
        found = {k: v[longest] for k, v in found.items()}
        a = b
    return hit, found


def _matches(found: dict[str, np.ndarray], first: np.ndarray, ids: pa.Array) -> pa.Array:
    """A list per row of its longest matches."""
    fields = [ids.take(pa.array(found["item"])), *(pa.array(x, pa.int64()) for x in (found["start"] - first[found["row"]], found["in_item"], found["n"]))]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(found["row"], np.arange(len(first))), pa.int32()), pa.StructArray.from_arrays(fields, names=["item_id", "doc_word", "item_word", "n_words"]))


def _runs(hit: np.ndarray, first: np.ndarray) -> pa.Array:
    """A list per row of its runs of hit words."""
    a, b = X.runs(hit, first)
    edge = np.searchsorted(a, first)
    shift = first[:-1].repeat(np.diff(edge))
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(a - shift, pa.int64()), pa.array(b - shift, pa.int64())], names=["a", "b"]))


def _search(sent: Broadcast):
    """(doc_id, text) to all columns of the result, for a benchmark of one block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in X.blocks(batch.column(1)):
                codes, first = _codes(data, offs)
                hit, found = search_shard(codes, first, sent.value)
                total, matches = np.r_[0, np.cumsum(hit)], _matches(found, first, sent.value["ids"])
                items = [sorted({m["item_id"] for m in x}) if x else [] for x in matches.to_pylist()] if len(found["row"]) else [[]] * (b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(total[first]), pa.int64()), pa.array(items, pa.list_(pa.string())), matches], names=["doc_id", "n_words", "n_hit", "items", "matches"])

    return search


def _search_block(sent: Broadcast):
    """(key, key2, text) to the keys, hit runs and matches of the rows that one of several blocks hits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in X.blocks(batch.column(2)):
                codes, first = _codes(data, offs)
                hit, found = search_shard(codes, first, sent.value)
                some = pa.array(np.unique(found["row"]), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a).take(some) for c in batch.columns[:2]), _runs(hit, first).take(some), _matches(found, first, sent.value["ids"]).take(some)], names=["key", "key2", "runs", "matches"])

    return search


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, key2, text) to (doc_id, key, key2, n_words)."""
    for batch in batches:
        for a, b, data, offs in X.blocks(batch.column(3)):
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:3]), pa.array(np.diff(_codes(data, offs)[1]), pa.int64())], names=["doc_id", "key", "key2", "n_words"])


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, span: int = 10) -> DataFrame:
    """Find every benchmark window in every document; one row per row of ``docs``.

    A-Z are lower-cased; a word is a run of digits, a-z and characters past ASCII. A window is
    ``span`` consecutive words of an item (all words of a shorter one). Returns doc_id, n_words,
    n_hit (words inside an occurrence of a window), items (ids of items with occurring windows,
    as strings, each once) and matches (for each such item the longest verbatim match with a
    window: item_id, doc_word and item_word where it begins, n_words; of equal ones the first).

    Matches too short for a window are found but not told. Null and empty texts have no words and
    no hits; null or empty items have no windows. Items with one item_id are one item; items
    without item_id are named ''. Rows that repeat a doc_id are judged each on their own, rows
    without one, too. An empty benchmark hits nothing, and no rows give no rows. Other columns are
    not read, whatever their names. Texts of any length are searched whole.
    """
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, ceil(size / ITEM_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def block(k: int) -> Broadcast:
        got = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        return docs.sparkSession.sparkContext.broadcast(item_block([r[0] for r in got], [r[1] for r in got], span))

    if n_blocks == 1:
        return rows.mapInArrow(_search(block(0)), OUT)
    key = [F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "doc_id", "text").alias("key2")]
    found = None
    for k in range(n_blocks):
        part = rows.select(*key, "text").mapInArrow(_search_block(block(k)), f"key long, key2 long, runs array<{RUN}>, matches array<{MATCH}>")
        found = part if found is None else found.unionByName(part)
    gathered = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = found.groupBy("key", "key2").agg(gathered("runs"), gathered("matches"))
    words = rows.select("doc_id", *key, "text").mapInArrow(_counted, "doc_id long, key long, key2 long, n_words long")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    both = words.join(found, ["key", "key2"], "left").select("doc_id", "n_words", none("runs", RUN), none("matches", MATCH))
    # the words that runs cover: those past the furthest end so far, in the order of their starts
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    n_hit = F.aggregate("runs", start, lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")), lambda s: s["n"])
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))).alias("items"), "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10) -> DataFrame:
    """Rows of ``docs`` whose doc_id has no hit, with all their columns.

    Rows without doc_id stay. Of rows that repeat a doc_id all go if one has a hit. Null and empty
    texts stay; an empty benchmark removes nothing; no rows give no rows.
    """
    bad = benchmark_matches(docs, benchmark, span).where("n_hit > 0").select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["__hit"], "left_anti")
