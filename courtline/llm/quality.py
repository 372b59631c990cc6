"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and byte n-grams (with
word borders), and a softmax layer reads that average. Vectors and layer are trained in one
task by stochastic gradient descent in numpy, over at most ``2 * SAMPLE`` labelled
documents (half of each class, by the hash of their ids), whose features other tasks count
over whole texts; the driver gets the finished weights alone. Both layers are linear, so the trained model is one number per hash slot:
scoring a text is a mean of table look-ups inside each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as X

#: Most labelled documents of each class that a model is fitted on.
SAMPLE = 1500
SLOTS, DIM, GRAMS, EPOCHS, RATE, SEED = 1 << 17, 8, (3, 4), 5, 1.0, 17
_FEATURES = "doc_id long, quality int, slots array<int>, counts array<int>"


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash slots and the rows they belong to (ascending), one pair for words and one for each n-gram length."""
    n_rows = len(offs) - 1
    row_of = np.repeat(np.arange(n_rows), np.diff(offs))
    spaced = np.full(len(data) + n_rows + 1, 0x20, np.uint8)
    spaced[np.arange(len(data)) + row_of + 1] = data
    rows = offs + np.arange(n_rows + 1) + 1  # where each row starts in spaced; the byte before is a space
    space = ~X.NOT_SPACE[spaced]
    spaced[space] = 0x20
    starts, ends = X.runs(~space, np.array([0, len(spaced)]))
    slot = np.uint64(SLOTS - 1)
    words, row = X.segment_hashes(X.byte_codes(11)[spaced], starts, ends), np.searchsorted(rows, starts, side="right") - 1
    yield (words & slot).astype(np.int32), row
    again = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1])) + 1  # a word pair that repeats its word
    yield np.full(len(again), SLOTS, np.int32), row[again]
    codes, gaps = X.byte_codes(12)[spaced], np.r_[0, np.cumsum(space)]
    for k in GRAMS:
        h = X.window_hashes(codes, k)
        if not len(h):
            continue
        inner = gaps[k - 1 : -1] - gaps[1 : len(gaps) - k + 1]  # spaces strictly inside
        ok = np.flatnonzero((inner == 0) & ((gaps[k:] - gaps[: len(h)]) < 2))
        yield (h[ok] & slot).astype(np.int32), np.minimum(np.searchsorted(rows, ok + 1, side="right") - 1, n_rows - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in X.blocks(batch.column(1)):
            slots, rows = [np.concatenate(x) for x in zip(*_features(data, offs), strict=True)]
            key, count = np.unique(rows.astype(np.int64) * (SLOTS + 1) + slots, return_counts=True)
            edge = pa.array(np.searchsorted(key // (SLOTS + 1), np.arange(b - a + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 2)), pa.ListArray.from_arrays(edge, pa.array((key % (SLOTS + 1)).astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(count.astype(np.int32)))], names=["doc_id", "quality", "slots", "counts"])


def train(samples: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weight of each slot and bias, from (slots, counts, label); documents without features are passed over."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (SLOTS + 1, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    samples = [x for x in samples if len(x[0])]
    steps, done = max(1, EPOCHS * len(samples)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            slots, counts, label = samples[i]
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[slots]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            rate = np.float32(RATE * (1 - done / steps))
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * np.float32(0.1) * p
            vectors[slots] -= (rate * share * np.float32(len(slots) ** 0.5))[:, None] * back[None, :]
            done += 1
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def _trained(table: pa.Table) -> pa.Table:
    """The one model of all sampled documents, which come in the order of their ids."""
    table = table.sort_by([("doc_id", "ascending")])
    slots, counts = (table.column(c).combine_chunks() for c in ("slots", "counts"))
    weights, bias = train([(s.values.to_numpy(), c.values.to_numpy(), q.as_py()) for s, c, q in zip(slots, counts, table.column("quality"), strict=True)])
    return pa.table({"weights": pa.array([weights], pa.list_(pa.float64())), "bias": [bias]})


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train on labelled documents outside the held-out part; with one class or none every score is that class's or 0.5."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    pick = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        pick = part if pick is None else pick.unionByName(part)
    pick = pick.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(pick), "doc_id")
    features = texts.select("doc_id", "text", "quality").mapInArrow(_counted, _FEATURES)
    got = features.groupBy(F.lit("all")).applyInArrow(_trained, "weights array<double>, bias double").toArrow()
    if not len(got):
        return train([])
    return got.column("weights").combine_chunks().values.to_numpy(), got.column("bias")[0].as_py()


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for a, b, data, offs in X.blocks(batch.column(1)):
                total, many = np.zeros(b - a), np.zeros(b - a, np.int64)
                for slots, rows in _features(data, offs):
                    count = np.bincount(rows, minlength=b - a)
                    full = np.flatnonzero(count)
                    if len(full):
                        total[full] += np.add.reduceat(table[slots], (np.cumsum(count) - count)[full])
                    many += count
                z = total / np.maximum(many, 1) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 6))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score the quality of every row of ``docs``; one row per row.

    Labels are learned only from rows that held_out() leaves, and nothing but the text is read
    for a score. Returns doc_id, held_out, score (0 to 1, higher: label 1 likelier, rounded to
    six digits) and predicted (1 if score >= threshold).

    Null, empty and blank texts have no features and get the score of the bias alone. Rows that
    repeat a doc_id are scored each on their own; rows without doc_id are scored, too, and are
    not held out. Other columns are not looked at; labels other than 0 and 1 are passed over.
    """
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
