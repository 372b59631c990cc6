"""Thinning of ordered rows: a row is kept if it differs enough from the last one that was kept.

Whether a row is kept depends on all rows before it, yet no task reads all rows of a key. Rows are
cut into chunks by ranges of (key, order), and every chunk is thinned as if its first row were kept. Then
seams are repaired: a chunk is thinned again from what its predecessor really kept last, until it
keeps a row that it had kept before, from where on both agree. Chunks whose predecessor's last row
did not change are done; mostly one round repairs all. A task reads its chunks batch by batch and
carries one signature over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import stored


class _Chunk:
    """One chunk while its rows come in."""

    def __init__(self, threshold: float):
        self.threshold, self.last, self.order, self.agreed = threshold, None, None, False

    def start(self, signature: np.ndarray, order) -> None:
        self.last, self.order = signature, order

    def keep(self, m: np.ndarray, was: np.ndarray) -> np.ndarray:
        """Places of the kept rows among the next rows; ``was``: which were kept before."""
        if self.agreed:
            return np.flatnonzero(was)
        kept, at = [], 0
        while at < len(m):
            if self.last is None:
                found = at
            else:
                found, step = -1, 16  # a first far enough row is sought in steps that grow
                while found < 0 and at < len(m):
                    far = np.flatnonzero(np.abs(m[at : at + step] - self.last).mean(axis=1) >= self.threshold)
                    found, at, step = (at + int(far[0]), at, step) if len(far) else (-1, at + step, 2 * step)
                if found < 0:
                    break
            kept.append(found)
            self.last = m[found]
            at = found + 1
            if was[found]:
                self.agreed = True
                return np.concatenate([kept, at + np.flatnonzero(was[at:])]).astype(np.int64)
        return np.array(kept, np.int64)


def _thin(threshold: float):
    """(k, c, o, s, was, state) sorted by chunk, state first, to kept rows (k, c, o) and each chunk's last kept one with its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, name, kinds = None, None, None

        def told(k: pa.Array, c: pa.Array, o: pa.Array, s: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([k, c, o, pa.array(s, pa.list_(pa.float64()))], names=["k", "c", "o", "s"])

        def ended() -> Iterator[pa.RecordBatch]:
            if chunk is not None and chunk.last is not None:
                yield told(pa.array([name[0]], kinds[0]), pa.array([name[1]], kinds[1]), pa.array([chunk.order], kinds[2]), [chunk.last.tolist()])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, c, o = batch.columns[:3]
            kinds = (k.type, c.type, o.type)
            m = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            was, state = (batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (4, 5))
            code = k.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            where = c.to_numpy()
            cuts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (where[1:] != where[:-1])])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                here = (k[a].as_py(), c[a].as_py())
                if here != name:
                    yield from ended()
                    chunk, name = _Chunk(threshold), here
                if state[a]:
                    chunk.start(m[a], o[a].as_py())
                    a += 1
                got = a + chunk.keep(m[a:b], was[a:b])
                if len(got):
                    chunk.last, chunk.order = m[got[-1]], o[int(got[-1])].as_py()
                    at = pa.array(got)
                    yield told(k.take(at), c.take(at), o.take(at), [None] * len(got))
        yield from ended()

    return run


def diverse_thin(rows: DataFrame, key: str, order: str, signature: str, threshold: float, parts: int | None = None) -> DataFrame:
    """(key, order) of the rows whose mean absolute difference to the last kept one of their key reaches ``threshold``; the first is kept.

    Rows come in the order of ``order``, once per key; signatures are numbers, all of one length. Rows
    without key, order or signature are left out. ``parts``: ranges that rows are cut into (else the session's).
    """
    kinds = dict(rows.dtypes)
    base = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(signature).cast("array<double>").alias("s")).where("k is not null and o is not null and s is not null")
    dealt = base.repartitionByRange(parts, "k", "o") if parts else base.repartitionByRange("k", "o")
    dealt = stored(dealt.withColumn("c", F.spark_partition_id()).select("k", "c", "o", "s"), "dealt")
    schema = f"k {kinds[key]}, c int, o {kinds[order]}, s array<double>"

    def thinned(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        dealt_out = chunks.repartition("k", "c").sortWithinPartitions("k", "c", F.desc("state"), "o")
        got = stored(dealt_out.select("k", "c", "o", "s", "was", "state").mapInArrow(_thin(threshold), schema), "thinned")
        return got.where("s is null").select("k", "c", "o"), got.where("s is not null")

    kept, last = thinned(dealt.withColumn("was", F.lit(False)).withColumn("state", F.lit(False)))
    begun = last.select("k", "c", F.lit(None).cast(kinds[order]).alias("began"))
    while True:
        before = F.lag(F.struct("o", "s")).over(W.partitionBy("k").orderBy("c"))
        wrong = last.withColumn("b", before).select("k", "c", "b.o", "b.s").join(begun, ["k", "c"]).where("o is not null and not o <=> began")
        wrong = stored(wrong.drop("began"), "seams")
        if wrong.isEmpty():
            return kept.select(F.col("k").alias(key), F.col("o").alias(order))
        again = dealt.join(wrong.select("k", "c"), ["k", "c"], "left_semi").join(kept.withColumn("was", F.lit(True)), ["k", "c", "o"], "left")
        again = again.select("k", "c", "o", "s", F.coalesce("was", F.lit(False)).alias("was"), F.lit(False).alias("state"))
        states = wrong.select("k", "c", "o", "s", F.lit(False).alias("was"), F.lit(True).alias("state"))
        new_kept, new_last = thinned(again.unionByName(states))
        others = lambda df: df.join(wrong.select("k", "c"), ["k", "c"], "left_anti")  # noqa: B023, E731
        kept, last = stored(others(kept).unionByName(new_kept), "kept"), stored(others(last).unionByName(new_last), "last")
        begun = stored(others(begun).unionByName(wrong.select("k", "c", F.col("o").alias("began"))), "begun")
