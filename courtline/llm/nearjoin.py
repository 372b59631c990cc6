"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles; documents with equal sets are one class from
the start. Each set has a sketch of ``SKETCH`` minimum hashes. In every run a set chooses
about ``CHOSEN`` of its sketch's tokens by a hash that all sets share, and joins the bucket
of each; buckets over ``SMALL`` sets are split again and again on tokens chosen along the path
(never one that is on the path already), and small buckets are compared by brute force. A large bucket that a further token hardly makes
smaller is dense: dense buckets that overlap are one group, which is compared by brute force in
tiles. Runs are repeated
until a pair at the threshold meets in one of them with probability ``RECALL``. What buckets find are only
candidates: connected ones meet once more with their whole sets, where every pair is decided
exactly. Large groups are cut into tiles, and a tile returns link counts and one
edge per set, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as X
from .saved import attach, components, saved

SHINGLE, THRESHOLD = 5, 0.8
SKETCH, CHOSEN, SMALL, TILE, DENSE, RECALL = 64, 2.0, 256, 256, 0.25, 0.99999
#: Sets of a component with more bytes than this a member are dealt to more tiles; rows and bytes of a task's bundle.
MEMBER_BYTES, BUNDLE_ROWS, BUNDLE_BYTES = 1 << 16, 16_000, 32 << 20
#: Fixed value: a pair at the threshold falls under it by five standard deviations.
CANDIDATE = int(SKETCH * (THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / SKETCH) ** 0.5))
COLUMNS = 4096


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has chosen a common token with this probability."""
    return ceil(log(1 - recall) / (SKETCH * THRESHOLD * log(1 - CHOSEN / SKETCH)))


RUNS = runs_for(RECALL)
_SEEDS = X.mix(np.arange(1, SKETCH + 1, dtype=np.uint64), 77) | np.uint64(1)
_LIMIT = np.uint64(int(CHOSEN / SKETCH * (1 << 64)))


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and each row's first one (n+1 values)."""
    data = X.LOWER[data]
    starts, ends, first = X.words(data, offs, X.ALNUM)
    codes, length = X.segment_hashes(X.byte_codes(3)[data], starts, ends), np.diff(first)
    n_shingles = np.where(length > 0, np.maximum(1, length - SHINGLE + 1), 0)
    row = np.repeat(np.arange(len(length)), n_shingles)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + first[:-1][row]
    h = X.segment_hashes(codes, at, at + np.minimum(SHINGLE, length[row]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(length) + 1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, set name (two hashes), set size, bucket keys of all runs, 16 bits of each sketch value."""
    for batch in batches:
        for a, b, data, offs in X.blocks(batch.column(1)):
            h, first = shingle_sets(data, offs)
            size = np.diff(first)
            full = np.flatnonzero(size > 0)
            begin = first[:-1][full]
            sketch = np.empty((len(full), SKETCH), np.uint64)
            name = [np.add.reduceat(X.mix(h, s), begin) if len(full) else np.zeros(0, np.uint64) for s in (1, 2)]
            for k in range(SKETCH):
                if len(full):
                    v = h * _SEEDS[k]
                    v ^= v >> np.uint64(32)
                    sketch[:, k] = np.minimum.reduceat(v, begin)
            token = X.mix(sketch ^ _SEEDS[None, :])
            keys, whose, slots = [], [], []
            for r in range(RUNS):
                drawn = X.mix(token, 100 + r)
                i, k = np.nonzero(drawn < _LIMIT)
                keys.append(X.mix(token[i, k], 200 + r))
                whose.append(i)
                slots.append(k)
            keys, whose, slots = (np.concatenate(x) for x in (keys, whose, slots))
            order = np.argsort(whose, kind="stable")
            chosen = pa.StructArray.from_arrays([pa.array(keys[order].astype(np.int64)), pa.array(np.int64(1) << slots[order].astype(np.int64))], names=["key", "used"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a).take(pa.array(full)),
                    pa.array(name[0].astype(np.int64)),
                    pa.array(name[1].astype(np.int64)),
                    pa.array(size[full], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(whose, minlength=len(full)))], pa.int32()), chosen),
                    pa.array([x.tobytes() for x in (token & np.uint64(0xFFFF)).astype(np.uint16)], pa.binary()),
                ],
                names=["doc_id", "k1", "k2", "n", "keys", "sketch"],
            )


def _next_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, sketch, many, used) of large buckets to the buckets one level down the path; used: bits of the path's tokens."""
    for batch in batches:
        key = batch.column(0).to_numpy().astype(np.uint64)
        if not len(key):
            continue
        token = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(key), SKETCH).astype(np.uint64)
        token = X.mix(token ^ _SEEDS[None, :])
        used, bit = batch.column(4).to_numpy(), np.int64(1) << np.arange(SKETCH, dtype=np.int64)
        i, k = np.nonzero((X.mix(token ^ key[:, None], 300) < _LIMIT) & ((used[:, None] & bit) == 0))
        yield pa.RecordBatch.from_arrays([pa.array(X.mix(token[i, k] ^ key[i], 301).astype(np.int64)), *(batch.column(c).take(pa.array(i)) for c in (1, 3)), pa.array(used[i] | bit[k])], names=["key", "rep", "above", "used"])


def _roots(near: np.ndarray) -> np.ndarray:
    """(groups, m, m) symmetric adjacency with a full diagonal to the least member each member reaches."""
    m = near.shape[1]
    label = np.broadcast_to(np.arange(m), near.shape[:2])
    while True:
        new = np.where(near, label[:, None, :], m).min(axis=2)
        if (new == label).all():
            return label
        label = new


def _compare_buckets(table: pa.Table) -> pa.Table:
    """Brute force inside each (key, part) of a bundle: an edge from each set to the least one it reaches."""
    table = table.sort_by([("key", "ascending"), ("part", "ascending"), ("rep", "ascending")]).combine_chunks()
    key, part, rep = (table.column(c).to_numpy() for c in ("key", "part", "rep"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(key), SKETCH)
    at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    size = np.diff(np.r_[at, len(key)])
    left, right = [], []
    for m in np.unique(size[size > 1]):
        group = at[size == m]
        step = max(1, (1 << 22) // int(m * m))
        for a in range(0, len(group), step):
            place = group[a : a + step, None] + np.arange(m)
            s = sketch[place]
            equal = np.zeros((len(place), m, m), np.uint8)
            for k in range(SKETCH):
                equal += s[:, :, None, k] == s[:, None, :, k]
            root = _roots(equal >= CANDIDATE)
            i, j = np.nonzero(root != np.arange(m))
            left.append(rep[place[i, j]])
            right.append(rep[place[i, root[i, j]]])
    out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def _tiled(df: DataFrame, group: str, count: str, member: str) -> DataFrame:
    """Rows of groups over TILE dealt to tiles: each pair of members meets in one tile at least.

    part is 0 for small groups; a member of one of n slices goes to the n tiles of its slice.
    """
    n = F.ceil(F.col(count) / TILE).cast("int")
    mine = F.pmod(F.xxhash64(member), n.cast("long")).cast("int")
    tiles = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y")))).otherwise(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))
    return df.withColumn("__t", F.explode(tiles)).withColumn("mine", mine).withColumn("x", F.col("__t.x")).withColumn("y", F.col("__t.y")).withColumn("part", F.col("x").cast("long") * (1 << 31) + F.col("y")).drop("__t")


def _exact(table: pa.Table) -> pa.Table:
    """Whole sets of one bundle: per (component, tile) each set's links inside the tile and the least set it reaches."""
    table = table.sort_by([("component", "ascending"), ("part", "ascending"), ("rep", "ascending")]).combine_chunks()
    comp, part, rep, copies, mine, x, y = (table.column(c).to_numpy() for c in ("component", "part", "rep", "copies", "mine", "x", "y"))
    once = np.ones(len(rep), bool)  # a doc_id that is repeated with one text comes once
    once[1:] = (rep[1:] != rep[:-1]) | (part[1:] != part[:-1]) | (comp[1:] != comp[:-1])
    comp, part, rep, copies, mine, x, y = (v[once] for v in (comp, part, rep, copies, mine, x, y))
    raw = table.column("hashes").filter(pa.array(once)).to_pylist()
    at = np.flatnonzero(np.r_[True, (comp[1:] != comp[:-1]) | (part[1:] != part[:-1])])
    out_rep, out_links, out_root = [], [], []
    for a, b in zip(at.tolist(), np.r_[at[1:], len(comp)].tolist(), strict=True):
        if b - a < 2:
            continue
        sets = [np.frombuffer(h, np.uint64) for h in raw[a:b]]
        size = np.array([len(s) for s in sets])
        if b - a == 2:
            both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
            common = np.array([[size[0], both], [both, size[1]]], np.float64)
        else:
            row = np.repeat(np.arange(b - a), size)
            token = np.unique(np.concatenate(sets), return_inverse=True)[1]
            often = np.bincount(token) > 1
            row, token = row[often[token]], (np.cumsum(often) - 1)[token[often[token]]]
            common = np.zeros((b - a, b - a))
            by = np.argsort(token, kind="stable")
            row, token = row[by], token[by]
            for c in range(0, int(often.sum()), COLUMNS):
                lo, hi = np.searchsorted(token, [c, c + COLUMNS])
                grid = np.zeros((b - a, COLUMNS), np.float32)
                grid[row[lo:hi], token[lo:hi] - c] = 1
                common += grid @ grid.T
            np.fill_diagonal(common, size)
        near = common >= THRESHOLD * (size[:, None] + size[None, :] - common) - 1e-9
        if x[a] != y[a]:  # pairs inside one slice are counted in that slice's own tile
            near &= (mine[a:b, None] != mine[None, a:b]) | np.eye(b - a, dtype=bool)
        links = (near * copies[None, a:b]).sum(axis=1) - copies[a:b]
        root = _roots(near[None])[0]
        out_rep.append(rep[a:b])
        out_links.append(links)
        out_root.append(rep[a + root])
    cat = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64())
    return pa.table({"rep": cat(out_rep), "links": cat(out_links), "root": cat(out_root)})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, size, rep, copies, k1, text) to whole sets; texts that are not the class's are left out."""
    for batch in batches:
        for a, b, data, offs in X.blocks(batch.column(5)):
            h, first = shingle_sets(data, offs)
            full = np.diff(first) > 0
            name = np.zeros(b - a, np.uint64)
            if full.any():
                name[full] = np.add.reduceat(X.mix(h, 1), first[:-1][full])
            ok = np.flatnonzero(full & (name.astype(np.int64) == batch.column(4).slice(a, b - a).to_numpy()))
            part = batch.slice(a, b - a).take(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([h[first[i] : first[i + 1]].tobytes() for i in ok], pa.binary())], names=["component", "size", "rep", "copies", "hashes"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Join documents with a Jaccard similarity of 0.8 or more over five-word shingles.

    A-Z are lower-cased; a word is a run of digits, a-z and characters past ASCII; a text of one
    to four words is one shingle. Returns one row per doc_id: doc_id, class_id (the least doc_id
    of the documents it is connected with by links), n_links (documents it is similar to, equal
    sets included), copy_of (least doc_id with the same set) and n_shingles.

    Null and empty texts have no shingles, no links, and are their own class. Of rows that repeat
    a doc_id one counts. Rows without doc_id are left out. No rows give no rows. Other columns are
    not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = rows.mapInArrow(_signatures, "doc_id long, k1 long, k2 long, n long, keys array<struct<key: long, used: long>>, sketch binary")
    one = signed.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n", "keys", "sketch")).alias("s")).select("doc_id", "s.*")
    one = saved(one, "signatures")
    reps = one.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    reps = saved(reps, "classes")

    sketches = reps.select("rep", "sketch")
    level = reps.select(F.inline("keys"), "rep", F.lit(None).cast("long").alias("above"))
    found, dense_edges, n_rows = None, None, 0
    while True:
        counts = saved(level.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "counts")
        met = saved(attach(level, counts, "key", counts.withColumnRenamed("many", "n")), "buckets")
        small, large = met.where(F.col("many") <= SMALL), met.where(F.col("many") > SMALL)
        dense = F.coalesce(F.col("many") >= DENSE * F.col("above"), F.lit(False))
        found = small.select("key", "rep") if found is None else found.unionByName(small.select("key", "rep"))
        n_small, n_dense, n_large = met.agg(F.count_if(F.col("many") <= SMALL), F.count_if((F.col("many") > SMALL) & dense), F.count_if((F.col("many") > SMALL) & ~dense)).first()
        n_rows += n_small
        if n_dense:
            groups = large.where(dense)
            least = groups.groupBy("key").agg(F.min("rep").alias("b"))
            stars = attach(groups.select("key", "rep"), least, "key", groups.groupBy("key").agg(F.first("many").alias("n"))).select(F.col("rep").alias("a"), "b")
            dense_edges = stars if dense_edges is None else dense_edges.unionByName(stars)
        if not n_large:
            break
        level = saved(large.where(~dense).join(sketches, "rep").select("key", "rep", "sketch", "many", "used").mapInArrow(_next_keys, "key long, rep long, above long, used long"), "level")
    compared = found.select("key", F.lit(0).cast("long").alias("part"), "rep", F.xxhash64("key").alias("bundle"))
    if dense_edges is not None:
        groups = components(dense_edges).toDF("rep", "key")
        counts = groups.groupBy("key").agg(F.count("*").alias("many"))
        groups = saved(attach(groups, counts, "key", counts.withColumnRenamed("many", "n")), "groups")
        n_rows += groups.agg(F.sum(F.ceil(F.col("many") / TILE))).first()[0] or 0
        tiles = _tiled(groups, "key", "many", "rep").select("key", "part", "rep", F.when(F.col("many") > TILE, F.xxhash64("key", "part")).otherwise(F.xxhash64("key")).alias("bundle"))
        compared = compared.unionByName(tiles)
    compared = compared.join(sketches, "rep").withColumn("bundle", F.pmod("bundle", F.lit(max(16, n_rows // BUNDLE_ROWS))))
    edges = compared.groupBy("bundle").applyInArrow(_compare_buckets, "a long, b long")
    grouped = saved(components(edges).join(reps.select(F.col("rep").alias("node"), "copies", "k1", F.col("n").alias("n_hashes")), "node"), "grouped")
    sizes = grouped.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("n_hashes") * 8).alias("bytes"))
    size = sizes.select("component", F.greatest("n", F.ceil(F.col("bytes") / MEMBER_BYTES)).alias("size"))
    wanted = attach(grouped, size, "component", sizes)
    n_bytes = wanted.agg(F.sum(F.col("n_hashes") * 8 * F.ceil(F.col("size") / TILE))).first()[0] or 0
    sets = rows.join(wanted.hint("merge"), rows["doc_id"] == wanted["node"]).select("component", "size", F.col("node").alias("rep"), "copies", "k1", "text").mapInArrow(_sets, "component long, size long, rep long, copies long, hashes binary")
    tiles = _tiled(sets, "component", "size", "rep")
    bundle = F.pmod(F.when(F.col("size") > TILE, F.xxhash64("component", "part")).otherwise(F.xxhash64("component")), F.lit(max(16, n_bytes // BUNDLE_BYTES)))
    decided = saved(tiles.withColumn("bundle", bundle).groupBy("bundle").applyInArrow(_exact, "rep long, links long, root long"), "links")
    links = decided.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(decided.select(F.col("rep").alias("a"), F.col("root").alias("b"))).toDF("rep", "class_id")
    facts = reps.select("k1", "k2", "rep", "copies", "n").join(links, "rep", "left").join(classes, "rep", "left")
    facts = facts.select("k1", "k2", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("rep").alias("copy_of"), F.col("n").alias("n_shingles"))
    known = attach(one.select("doc_id", "k1", "k2"), facts, "k1", reps.select("k1", F.col("copies").alias("n")), also="k2").drop("k1", "k2")
    ids = rows.select("doc_id").distinct()
    return ids.join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"))
