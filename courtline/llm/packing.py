"""Conflict-constrained best-fit packing.

Documents are dealt by their ids to shards of about ``SHARD`` documents, and a shard is packed
in one task from lengths, sources and duplicate clusters alone. Longest pieces go first. Bins
are kept by residual room, with a bitmap of the residuals in use; a bin carries a bitmap of
its sources and one of its duplicate clusters. From the least residual that holds a piece the
successor search goes on until a bin without a common source or cluster is found: the tightest
compatible one. Bins of one residual are kept by source bitmap, so a hot source is passed over
at once and not bin by bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as X
from .nearjoin import near_duplicates

#: Words in a bin, and documents that are packed together.
CAPACITY, SHARD = 1024, 4000


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each piece, in the given order; sources and clusters are bitmaps with one bit (cluster 0: none)."""
    levels: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
    used, room, of_sources, of_clusters, out = 0, [], [], [], []
    for n, source, cluster in zip(lengths, sources, clusters, strict=True):
        found, ahead = -1, used >> n << n
        while ahead and found < 0:
            r = (ahead & -ahead).bit_length() - 1
            for mask, bins in levels[r].items():
                if mask & source:
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    if not of_clusters[bins[k]] & cluster:
                        found = bins.pop(k)
                        break
                if found >= 0:
                    if not bins:
                        del levels[r][mask]
                        if not levels[r]:
                            used &= ~(1 << r)
                    break
            ahead &= ahead - 1
        if found < 0:
            found = len(room)
            room.append(capacity)
            of_sources.append(0)
            of_clusters.append(0)
        room[found] -= n
        of_sources[found] |= source
        of_clusters[found] |= cluster
        if r := room[found]:
            levels[r].setdefault(of_sources[found], []).append(found)
            used |= 1 << r
        out.append(found)
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, text, key) to (doc_id, source, n_words, words, key): words names the lower-cased words in order."""
    for batch in batches:
        for a, b, data, offs in X.blocks(batch.column(2)):
            starts, ends, first = X.words(data, offs, X.NOT_SPACE)
            codes = X.segment_hashes(X.byte_codes(14)[X.LOWER[data]], starts, ends)
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(np.diff(first), pa.int64()), pa.array(X.segment_hashes(codes, first[:-1], first[1:]).astype(np.int64)), batch.column(3).slice(a, b - a)], names=["doc_id", "source", "n_words", "words", "key"])


OUT = "doc_id long, part int, start_word long, n_words long, bin_id long, bin_offset long"


def _pack(capacity: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        shard = int(key[0].as_py())
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("words", "ascending"), ("source", "ascending")])
        length = table.column("n_words").to_numpy()
        source = np.unique(np.array([x or "" for x in table.column("source").to_pylist()], object), return_inverse=True)[1] if len(length) else length
        _, cluster, copies = np.unique(table.column("cluster").to_numpy(), return_inverse=True, return_counts=True)
        bit = np.where(copies[cluster] > 1, (np.cumsum(copies > 1) - 1)[cluster], -1)  # only clusters with copies need one
        full, rest = length // capacity, length % capacity
        pieces = np.flatnonzero(rest > 0)
        pieces = pieces[np.argsort(-rest[pieces], kind="stable")]
        got = best_fit(rest[pieces].tolist(), [1 << s for s in source[pieces].tolist()], [1 << b if b >= 0 else 0 for b in bit[pieces].tolist()], capacity)
        n_bins, at, rows = max(got, default=-1) + 1, {}, []
        doc = table.column("doc_id").to_pylist()
        for i, where in zip(pieces.tolist(), got, strict=True):
            begin = at.get(where, 0)
            at[where] = begin + int(rest[i])
            rows.append((doc[i], int(full[i]), int(full[i]) * capacity, int(rest[i]), (shard << 32) + where, begin))
        for i in np.flatnonzero(full).tolist():
            for k in range(int(full[i])):
                rows.append((doc[i], k, k * capacity, capacity, (shard << 32) + n_bins, 0))
                n_bins += 1
        rows += [(doc[i], 0, 0, 0, None, None) for i in np.flatnonzero(length == 0).tolist()]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "part", "start_word", "n_words", "bin_id", "bin_offset"])

    return pack


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, near: bool = True) -> DataFrame:
    """Pack whole documents into bins of ``capacity`` words; one row per piece.

    Words are runs of bytes other than ASCII white space. A document longer than a bin fills
    whole bins, and what is left of it is a piece to be packed; nothing is cut off. No bin has
    two pieces of one source, or of one duplicate cluster: texts that ``near_duplicates`` connects
    by links (Jaccard similarity of 0.8 or more), or whose words are equal but for A-Z and a-z.
    ``near`` is False for documents from which near copies are removed already: no links are
    sought then, and a cluster is texts with equal words.
    Returns doc_id, part, start_word, n_words, bin_id and bin_offset.

    Null, empty and blank texts take no room: one row with no words and no bin. Null sources are
    the source ''. Rows that repeat a doc_id are packed each on their own, and each has the cluster
    of its own text; rows without doc_id are dealt by their text and have clusters, too. No rows
    give no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    n_shards = max(1, ceil(rows.count() / SHARD))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))  # one for each text of a doc_id
    items = keyed.select("doc_id", "source", "text", "key").mapInArrow(_described, "doc_id long, source string, n_words long, words long, key long")
    if near:
        named = keyed.where("doc_id is not null").unionByName(keyed.where("doc_id is null").dropDuplicates(["key"]))
        classes = near_duplicates(named.select(F.col("key").alias("doc_id"), "text")).where("n_links > 0").select(F.col("doc_id").alias("key"), "class_id")
        items = items.join(classes, "key", "left")
    else:
        items = items.withColumn("class_id", F.lit(None).cast("long"))
    items = items.select("doc_id", "source", "n_words", "words", F.coalesce("class_id", "words").alias("cluster"))
    shard = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)) + F.when(F.col("doc_id").isNull(), F.col("words")).otherwise(F.lit(0)), F.lit(n_shards))
    return items.withColumn("shard", shard.cast("long")).groupBy("shard").applyInArrow(_pack(capacity), OUT)
