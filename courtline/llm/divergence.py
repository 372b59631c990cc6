"""Source divergence audit by a recount through minimal perfect hashes.

A first pass counts exactly in how many documents of a language each term occurs and keeps the frequent
ones. They are cut into shards of about ``SHARD`` terms; a shard's minimal perfect hash gives every one of
its terms a slot of its own, without gaps, and the terms are stored in the order of their slots. The
second pass reads the texts again with the broadcast shards: a term's slot is computed, the
stored term there is compared with it, so terms that were not kept are told apart exactly, and the slot's
number in a dense array of the group (language and source) is increased. Shards that
are more than ``BROADCAST`` bytes together are broadcast one round after the other, over a table
of words that is counted once and read once.

Divergences are sums over all kept terms, also those that a source never uses, so they are
taken from dense counts: shard by shard, in tiles of ``TILE`` by ``TILE`` sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textarrays as X
from .saved import saved

KEPT, TOP = 3, 200
SHARD, TILE = 8192, 128
#: Bytes of perfect hashes that are broadcast at a time, and of dense slots that a task holds before it hands them on.
BROADCAST, DENSE = 48 << 20, 32 << 20
#: Displacements tried for a bucket before another seed is taken.
TRIES = 1 << 16
#: Fixed value: bytes of a term (A-Z, a-z and everything past ASCII).
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
SHARDS = "lang string, shard int, n int, seed int, moves binary, ends binary, keys binary"
COUNTS = "lang string, source string, shard int, slot int, n long"
#: Counts of one group and shard as two blocks of numbers, and how many tasks' blocks are added up at a time.
PACKED = "lang string, source string, shard int, slots binary, n binary"
MERGE = 256


# ---- terms -------------------------------------------------------------------------------------


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of each term of a block, and the block's distinct terms."""
    data = X.LOWER[data]
    starts, ends, first = X.words(data, offs, LETTER)
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    every = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[LETTER[data]]))
    coded = every.dictionary_encode()
    return np.repeat(np.arange(len(offs) - 1), np.diff(first)), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _coded(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = pc.fill_null(column.cast(pa.string()), "").dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _tally(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (under ``size``), ascending, and how often each occurs."""
    if size > 8 * len(key):
        return np.unique(key, return_counts=True)
    n = np.bincount(key)
    at = np.flatnonzero(n)
    return at, n[at]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, text) in batches of about a block, rows with equal keys beside each other: a block has few groups, and these repeat their terms."""
    for batch in batches:
        code, text = np.zeros(batch.num_rows, np.int64), batch.column(batch.num_columns - 1)
        for column in batch.columns[:-1]:
            one, names = _coded(column)
            code = code * len(names) + one
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)[order].astype(np.int64))
        for rows in np.split(order, np.flatnonzero(np.diff(ends // X.BLOCK_BYTES)) + 1):
            yield batch.take(pa.array(rows))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to lang, term and the documents of a block in which it occurs."""
    for batch in _together(batches):
        for a, b, data, offs in X.blocks(batch.column(1)):
            row, code, terms = _terms(data, offs)
            if not len(row):
                continue
            lang, langs = _coded(batch.column(0).slice(a, b - a))
            once = np.unique(row * len(terms) + code)
            key, docs = _tally(lang[once // len(terms)] * len(terms) + once % len(terms), len(langs) * len(terms))
            yield pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(key // len(terms))), terms.take(pa.array(key % len(terms))).cast(pa.string()), pa.array(docs)], names=["lang", "term", "docs"])


# ---- perfect hashes ----------------------------------------------------------------------------


def _hashes(terms: pa.Array, seed: int) -> np.ndarray:
    data, offs = X.flat(terms)
    return X.segment_hashes(X.byte_codes(50 + seed)[data], offs[:-1], offs[1:])


def _shards(h: np.ndarray, shards: np.ndarray | int) -> np.ndarray:
    """Shard of each term from its hash of seed 0."""
    return (X.mix(h, 9) % np.asarray(shards).astype(np.uint64)).astype(np.int32)


def _spot(h: np.ndarray, move: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    return (X.mix(h + np.asarray(move).astype(np.uint64) * _STEP, 4) % np.asarray(n).astype(np.uint64)).astype(np.int64)


def _buckets(n: int) -> int:
    return max(1, n // 2)


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Displacements per bucket and the slot of each of the hashes, which differ; None if no displacement was found.

    Hashes are dealt to buckets; from the largest buckets down, a bucket takes the first displacement
    that moves all its members to free slots. A bucket with one member is told its slot.
    """
    n, many = len(h), _buckets(len(h))
    bucket = ((h >> np.uint64(32)) % np.uint64(many)).astype(np.int64)
    order, size = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=many)
    first = np.cumsum(size) - size
    moves, slot, taken = np.zeros(many, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    for m in range(int(size.max()), 1, -1):
        waiting, move = np.flatnonzero(size == m), 0
        while len(waiting):
            if move == TRIES:
                return None
            member = order[first[waiting][:, None] + np.arange(m)]
            spot = _spot(h[member], move, n)
            inside = np.sort(spot, axis=1)
            ok = np.flatnonzero(~taken[spot].any(axis=1) & (inside[:, 1:] != inside[:, :-1]).all(axis=1))
            mine = np.zeros(len(ok) * m, bool)  # of buckets that want one slot the first gets it
            mine[np.unique(spot[ok].ravel(), return_index=True)[1]] = True
            ok = ok[mine.reshape(-1, m).all(axis=1)]
            taken[spot[ok]], moves[waiting[ok]], slot[member[ok]] = True, move, spot[ok]
            waiting, move = np.delete(waiting, ok), move + 1
    alone, free = np.flatnonzero(size == 1), np.flatnonzero(~taken)
    moves[alone], slot[order[first[alone]]] = -1 - free, free
    return moves, slot


def _build(table: pa.Table) -> pa.Table:
    """The terms of one shard to its perfect hash with the terms in the order of their slots."""
    terms = table.column("term").combine_chunks().cast(pa.large_string())
    seed, found = 0, None
    while found is None:
        seed += 1
        h = _hashes(terms, seed)
        found = perfect_hash(h) if len(np.unique(h)) == len(h) else None
    moves, slot = found
    data, offs = X.flat(terms.take(pa.array(np.argsort(slot))))
    row = [[table.column("lang")[0].as_py()], [table.column("shard")[0].as_py()], [len(terms)], [seed], [moves.tobytes()], [offs.astype(np.int32).tobytes()], [data.tobytes()]]
    return pa.table({name: pa.array(v, kind) for name, v, kind in zip(("lang", "shard", "n", "seed", "moves", "ends", "keys"), row, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)})


def _stored(ends: bytes, keys: bytes) -> pa.Array:
    offs = np.frombuffer(ends, np.int32)
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends), pa.py_buffer(keys))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, shard, ends, keys) to lang, shard, slot, term."""
    for batch in batches:
        for lang, shard, ends, keys in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            terms = _stored(ends, keys)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array(np.full(len(terms), shard, np.int32)), pa.array(np.arange(len(terms), dtype=np.int32)), terms], names=["lang", "shard", "slot", "term"])


class Lookup:
    """The shards of one language that are at hand: terms to their places among them, -1 for terms that they don't have."""

    def __init__(self, shards: int, rows: list):
        self.shards, self.of = shards, np.full(shards, -1, np.int64)
        self.ids = np.array([r.shard for r in rows], np.int32)
        self.of[self.ids] = np.arange(len(rows))
        self.n = np.array([r.n for r in rows], np.int64)
        self.seed = np.array([r.seed for r in rows])
        self.many = np.array([_buckets(r.n) for r in rows], np.int64)
        self.moves = np.concatenate([np.frombuffer(r.moves, np.int32) for r in rows])
        self.bucket_base, self.base = np.cumsum(self.many) - self.many, np.cumsum(self.n) - self.n
        self.keys = pa.chunked_array([_stored(r.ends, r.keys) for r in rows]).cast(pa.large_string()).combine_chunks()

    def places(self, terms: pa.Array, known: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """known: hashes of the terms by seed, where they are at hand; it is filled."""
        known = {} if known is None else known
        for seed in (0, *np.unique(self.seed).tolist()):
            if seed not in known:
                known[seed] = _hashes(terms, seed)
        out, which = np.full(len(terms), -1, np.int64), self.of[_shards(known[0], self.shards)]
        for seed in np.unique(self.seed).tolist():
            at = np.flatnonzero((which >= 0) & (self.seed[which] == seed))
            k, h = which[at], known[seed][at]
            move = self.moves[self.bucket_base[k] + ((h >> np.uint64(32)) % self.many[k].astype(np.uint64)).astype(np.int64)].astype(np.int64)
            slot = np.where(move < 0, -1 - move, _spot(h, np.maximum(move, 0), self.n[k]))
            out[at] = self.base[k] + slot
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), terms.take(pa.array(found)))
        out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        return out


# ---- second pass -------------------------------------------------------------------------------


class _Slots:
    """Dense counts per group of one task; handed on before they take more than ``DENSE`` bytes (or one group's)."""

    def __init__(self, tables: dict[str, Lookup]):
        self.tables, self.open, self.bytes = tables, {}, 0

    def add(self, lang: str, source: str, places: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts; yields what had to be handed on for a new group's slots."""
        if (lang, source) not in self.open:
            more = 8 * len(self.tables[lang].keys)
            if self.open and self.bytes + more > DENSE:
                yield from self.hand_on()
            self.open[lang, source] = np.zeros(len(self.tables[lang].keys), np.int64)
            self.bytes += more
        self.open[lang, source][places] += n

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (lang, source), dense in self.open.items():
            table, at = self.tables[lang], np.flatnonzero(dense)
            cuts = np.searchsorted(at, np.r_[table.base, len(dense)])
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                of = at[cuts[k] : cuts[k + 1]]
                rows.append((lang, source, int(table.ids[k]), (of - table.base[k]).astype(np.int32).tobytes(), dense[of].tobytes()))
        self.open, self.bytes = {}, 0
        for a in range(0, len(rows), 64):
            yield _blocks(rows[a : a + 64])


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["lang", "source", "shard", "slots", "n"])


def _added(table: pa.Table) -> pa.Table:
    """Blocks of one group and shard as one: a slot's counts are added up."""
    slots = [np.frombuffer(x, np.int32) for x in table.column("slots").to_pylist()]
    dense = np.zeros(max(int(x.max()) for x in slots) + 1, np.int64)
    for at, n in zip(slots, table.column("n").to_pylist(), strict=True):
        dense[at] += np.frombuffer(n, np.int64)
    at = np.flatnonzero(dense)
    first = [table.column(c)[0].as_py() for c in ("lang", "source", "shard")]
    return pa.Table.from_batches([_blocks([(*first, at.astype(np.int32).tobytes(), dense[at].tobytes())])]).append_column("task", table.column("task").slice(0, 1))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to counts, one block at a time."""
    for batch in batches:
        for row in range(batch.num_rows):
            slots, n = (np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in ((3, np.int32), (4, np.int64)))
            of = pa.array(np.full(len(slots), row))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in range(3)), pa.array(slots), pa.array(n)], names=["lang", "source", "shard", "slot", "n"])


def _summed_counts(blocks: DataFrame) -> DataFrame:
    """Blocks of all tasks to counts. ``MERGE`` tasks' blocks of a group and shard are added up at a time, so a hot group is no large task either."""
    blocks = saved(blocks.withColumn("task", F.spark_partition_id()), "blocks")
    tasks = (blocks.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        blocks = blocks.withColumn("task", F.floor(F.col("task") / MERGE).cast("int")).groupBy("lang", "source", "shard", "task").applyInArrow(_added, f"{PACKED}, task int")
        tasks = ceil(tasks / MERGE)
        if tasks == 1:
            return saved(blocks.drop("task").mapInArrow(_unpacked, COUNTS), "counts")
        blocks = saved(blocks, "blocks")


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[str, str]], pa.Array]]:
    """(lang, source, text): for each block the group, code and number of its terms, the groups and the terms."""
    for a, b, data, offs in X.blocks(batch.column(2)):
        row, code, terms = _terms(data, offs)
        if not len(row):
            continue
        (lang, langs), (source, sources) = (_coded(batch.column(c).slice(a, b - a)) for c in (0, 1))
        group, of = np.unique(lang * len(sources) + source, return_inverse=True)
        key, n = _tally(of[row] * len(terms) + code, len(group) * len(terms))
        yield key // len(terms), key % len(terms), n, [(langs[g // len(sources)], sources[g % len(sources)]) for g in group.tolist()], terms


def _recount(tables) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, source, text) to counts, through broadcast tables that hold all kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(tables.value)
        for batch in _together(batches):
            for group, code, n, groups, terms in _grouped(batch):
                known, hashes = {}, {}
                for lang in {g[0] for g in groups} & set(slots.tables):
                    of = np.unique(code[np.isin(group, [k for k, g in enumerate(groups) if g[0] == lang])])
                    for seed in (0, *np.unique(slots.tables[lang].seed).tolist()):
                        if seed not in hashes:
                            hashes[seed] = _hashes(terms, seed)
                    known[lang] = np.full(len(terms), -1, np.int64)
                    known[lang][of] = slots.tables[lang].places(terms.take(pa.array(of)), {seed: h[of] for seed, h in hashes.items()})
                for k, (lang, source) in enumerate(groups):
                    if lang in known:
                        lo, hi = np.searchsorted(group, [k, k + 1])
                        at = known[lang][code[lo:hi]]
                        yield from slots.add(lang, source, at[at >= 0], n[lo:hi][at >= 0])
        yield from slots.hand_on()

    return run


def _group_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to lang, source, term, n of each block."""
    for batch in _together(batches):
        for group, code, n, groups, terms in _grouped(batch):
            lang, source = (pa.array([g[c] for g in groups]).take(pa.array(group)) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, terms.take(pa.array(code)).cast(pa.string()), pa.array(n)], names=["lang", "source", "term", "n"])


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with term and, last, the number of shards, which becomes the term's shard."""
    for batch in batches:
        shard = _shards(_hashes(batch.column(batch.schema.get_field_index("term")), 0), batch.column(batch.num_columns - 1).to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shard)], names=[*batch.schema.names[:-1], "shard"])


def _recount_words(tables) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, source, term, n) to counts, through broadcast tables that hold the shards of one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(tables.value)
        for batch in batches:
            (lang, langs), (source, sources) = _coded(batch.column(0)), _coded(batch.column(1))
            n = batch.column(3).to_numpy()
            for k, name in enumerate(langs):
                if name in slots.tables:
                    of = np.flatnonzero(lang == k)
                    at = slots.tables[name].places(batch.column(2).take(pa.array(of)).cast(pa.large_string()))
                    of, at = of[at >= 0], at[at >= 0]
                    for s in np.unique(source[of]).tolist():
                        mine = source[of] == s
                        yield from slots.add(name, sources[s], at[mine], n[of[mine]])
        yield from slots.hand_on()

    return run


def _tables(rows: list, shards: dict[str, int]) -> dict[str, Lookup]:
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.shard)):
        by.setdefault(r.lang, []).append(r)
    return {lang: Lookup(shards[lang], of) for lang, of in by.items()}


def _rounds(hashes: DataFrame) -> list[list[tuple[str, int]]]:
    """Shards of which ``BROADCAST`` bytes at most are at hand at a time (one shard at least)."""
    out, room = [], 0
    for r in hashes.select("lang", "shard", (F.octet_length("keys") + F.octet_length("ends") + F.octet_length("moves")).alias("b")).orderBy("lang", "shard").toLocalIterator():
        if not out or room < r.b:
            out, room = [*out, []], BROADCAST
        out[-1].append((r.lang, r.shard))
        room -= r.b
    return out


def recount(rows: DataFrame, hashes: DataFrame, cut: DataFrame) -> DataFrame:
    """Counts (lang, source, shard, slot, n) of the kept terms of ``rows`` (lang, source, text), one row per group and term that occurs.

    hashes: the shards. cut: lang and shards, their number. What the driver holds is one
    round of shards and their names.
    """
    spark, rounds = rows.sparkSession, _rounds(hashes)
    if len(rounds) <= 1:
        took = hashes.collect()
        tables = spark.sparkContext.broadcast(_tables(took, {r.lang: sum(1 for x in took if x.lang == r.lang) for r in took}))
        return _summed_counts(rows.mapInArrow(_recount(tables), PACKED))
    words = rows.mapInArrow(_group_words, "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame([(lang, shard, k) for k, of in enumerate(rounds) for lang, shard in of], "lang string, shard int, round int")
    words = words.join(cut, "lang").mapInArrow(_sharded, "lang string, source string, term string, n long, shard int").join(names, ["lang", "shard"]).select("lang", "source", "term", "n", "round")
    words, counts = saved(words, "words", "round"), None
    total = {r.lang: r.shards for r in cut.join(names.select("lang").distinct(), "lang").toLocalIterator()}
    for k, of in enumerate(rounds):
        took = hashes.join(names.where(F.col("round") == k).select("lang", "shard"), ["lang", "shard"]).select(*hashes.columns).collect()
        tables = spark.sparkContext.broadcast(_tables(took, {lang: total[lang] for lang, _ in of}))
        part = _summed_counts(words.where(F.col("round") == k).drop("round").mapInArrow(_recount_words(tables), PACKED))
        tables.unpersist()
        counts = part if counts is None else counts.unionByName(part)
    return counts


# ---- divergences -------------------------------------------------------------------------------


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, of: Column) -> Column:
    """1 + floor(1,000,000,000 * count / of) without rounding: long division by thousands (of up to 9e15)."""
    out, rest = F.lit(1).cast("long"), count
    for unit in (1_000_000, 1_000, 1):
        out = out + _div(rest * 1000, of) * unit
        rest = F.pmod(rest * 1000, of)
    return out


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    out, rest = np.ones_like(count), count
    for unit in (1_000_000, 1_000, 1):
        out = out + rest * 1000 // of * unit
        rest = rest * 1000 % of
    return out


def _tile(key, head: pa.Table, entries: pa.Table) -> pa.Table:
    """All pairs of sources of one tile over one shard: sums of floor((p - q)**2 / q), for p of each and q of each other one."""
    i, j = int(key[2].as_py()), int(key[3].as_py())
    head = head.sort_by("idx")
    idx, block, total, v = (head.column(c).to_numpy() for c in ("idx", "block", "total", "v"))
    m = int(head.column("m")[0].as_py())
    count = np.zeros((len(idx), m), np.int64)
    count[np.searchsorted(idx, entries.column("idx").to_numpy()), entries.column("slot").to_numpy()] = entries.column("n").to_numpy()
    used = np.flatnonzero(count.any(axis=0))  # terms that none of them uses are alike: one column stands for all
    count = np.concatenate([count[:, used], np.zeros((len(idx), 1), np.int64)], axis=1)
    weight = np.r_[np.ones(len(used), np.int64), m - len(used)]
    p = _share(count + 1, (total + v)[:, None])
    left, right, value = [], [], []
    for a in range(len(idx)):
        other = np.flatnonzero((block != block[a]) if i != j else (np.arange(len(idx)) != a))
        step = max(1, (1 << 20) // p.shape[1])
        for lo in range(0, len(other), step):
            q = p[other[lo : lo + step]]
            d = p[a] - q
            value.append((d * d // q) @ weight)
        left.append(np.full(len(other), idx[a]))
        right.append(idx[other])
    return pa.table({"lang": pa.array([key[0].as_py()] * sum(map(len, left)), pa.string()), **{name: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for name, x in (("a", left), ("b", right), ("value", value))}})


def divergences(docs: DataFrame, kept: int = KEPT, top: int = TOP) -> DataFrame:
    """How do the sources of each language differ, and by which terms?

    A term is a run of letters (A-Z lower-cased, anything past ASCII counts as a letter). Terms in at
    least ``kept`` documents of a lang are kept for it, V of them. A group is a lang and a
    source. p = 1 + floor(10**9 * (count + 1) / (N + V)), with count the occurrences of a term in the
    group (or the whole lang) and N the sum of counts. Returns lang, source, part, item, value and rank: for part
    'pair' every other source of the lang, with the sum over all kept terms of
    floor((p - q)**2 / q), q being the other's p; for part 'term' the ``top`` terms that the group
    uses more than its lang does, with q the lang's p. Ranks go by value, then by item in UTF-8 order.

    Null lang, source and text are ''. A lang that keeps no terms has pairs with value 0. A lang
    with one source has no pairs. Every row is a document, repeated ones too. Long texts are read whole, one
    at a time. No rows give no rows; other columns are not looked at. N + V must be under
    9 * 10**15.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    frequent = rows.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
    frequent = saved(frequent.where(F.col("docs") >= kept).select("lang", "term"), "frequent")
    cut = saved(frequent.groupBy("lang").agg(F.count("*").alias("v")).withColumn("shards", F.ceil(F.col("v") / SHARD).cast("int")), "cut")
    hashes = frequent.join(cut.select("lang", "shards"), "lang").mapInArrow(_sharded, "lang string, term string, shard int").groupBy("lang", "shard").applyInArrow(_build, SHARDS)
    hashes = saved(hashes, "hashes")
    counts = recount(rows, hashes, cut.select("lang", "shards"))

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(cut, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    langs = W.partitionBy("lang")
    groups = groups.withColumn("idx", F.row_number().over(langs.orderBy("source")) - 1).withColumn("sources", F.count("*").over(langs)).withColumn("lang_total", F.sum("total").over(langs))
    groups = saved(groups, "groups")
    entries = saved(counts.join(groups, ["lang", "source"]), "entries")

    block, last = F.floor(F.col("idx") / TILE).cast("int"), F.floor((F.col("sources") - 1) / TILE).cast("int")
    tiles = F.inline(F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least(block, x).alias("i"), F.greatest(block, x).alias("j"))))
    head = groups.where("sources > 1").select("lang", "idx", block.alias("block"), "total", "v", tiles).join(hashes.select("lang", "shard", F.col("n").alias("m")), "lang")
    body = entries.where("sources > 1").select("lang", "shard", "slot", "n", "idx", tiles)
    keys = ["lang", "shard", "i", "j"]
    sums = head.groupBy(*keys).cogroup(body.groupBy(*keys)).applyInArrow(_tile, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda side, as_: groups.select("lang", F.col("idx").cast("long").alias(side), F.col("source").alias(as_))
    pairs = sums.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
    bare = groups.where("v = 0").select("lang", "source")
    pairs = pairs.unionByName(bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long")))

    terms = hashes.select("lang", "shard", "ends", "keys").mapInArrow(_slots, "lang string, shard int, slot int, term string")
    everywhere = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("all_n"))
    used = entries.join(everywhere, ["lang", "shard", "slot"]).join(terms, ["lang", "shard", "slot"])
    used = used.withColumn("p", share(F.col("n") + 1, F.col("total") + F.col("v"))).withColumn("q", share(F.col("all_n") + 1, F.col("lang_total") + F.col("v"))).where("p > q")
    used = used.select("lang", "source", F.col("term").alias("item"), _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [pairs.withColumn("rank", place).withColumn("part", F.lit("pair")), used.withColumn("rank", place).where(F.col("rank") <= top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")
