"""Source divergence, Merkle manifest and SimHash groups against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from courtline.llm import divergence, manifest, simhash
from courtline.llm import textarrays as X

from .common import LOWER, documents, frame, prose

EDGES = [(None, "the end of the beginning", None, None, None, "c", 1, "p", "r"), (None, None, None, None, None, "c", 1, "p", "r"), (None, "the end of the beginning", "en", "", 3, "c", 1, "p", "r"), (5, "X\x00Y ünd Ünd", "", "src1", 9, "c", 1, "p", "r")]


def _lower(text):
    return (text or "").translate(str.maketrans(LOWER))


# ---- divergence --------------------------------------------------------------------------------


def _divergence_oracle(rows, kept, top):
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(r[1]))
        docs[lang].update(set(words))
        groups[lang, source].update(words)
    out = set()
    for (lang, source), count in groups.items():
        terms = [t for t, n in docs[lang].items() if n >= kept]
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in terms) + len(terms)) for t in terms}  # noqa: B023, E731
        p = p_of(count)
        whole = sum((c for (x, _), c in groups.items() if x == lang), Counter())
        pairs = []
        for (x, other), c in groups.items():
            if x == lang and other != source:
                q = p_of(c)
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in terms), other.encode()))
        q = p_of(whole)
        most = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in terms if count[t] and p[t] > q[t])[:top]
        for part, found in (("pair", sorted(pairs)), ("term", most)):
            out |= {(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:  # several shards and rounds, tiles of two sources
        monkeypatch.setattr(divergence, "SHARD", 60)
        monkeypatch.setattr(divergence, "BROADCAST", 2500)
        monkeypatch.setattr(divergence, "TILE", 2)
        monkeypatch.setattr(divergence, "MERGE", 2)
    rng = random.Random(8)
    rows = documents() + EDGES + [(2000 + i, prose(rng, 30), "xx", f"s{i}", 1, "c", 1, "p", "r") for i in range(7)] + [(3000, "alone", "one", "s", 1, "c", 1, "p", "r"), (3001, "12", "one", "t", 1, "c", 1, "p", "r")]
    rows.append((4000, " ".join(prose(rng, 9) for _ in range(30_000)), "en", "src1", 1, "c", 1, "p", "r"))  # over one block
    got = divergence.divergences(frame(spark, rows), 3, 12)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == _divergence_oracle(rows, 3, 12)


def test_dense_slots_are_bounded(monkeypatch):
    langs, sources = ("en", "de"), [f"s{k}" for k in range(30)]
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows = [(lang, source, " ".join(words[(7 * k + i) % 300] for i in range(40))) for k in range(4) for source in sources for lang in langs]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])
    built = [divergence._build(pa.table({"lang": [lang] * 300, "term": words, "shard": pa.array([0] * 300, pa.int32())})) for lang in langs]
    tables = divergence._tables([SimpleNamespace(**t.to_pylist()[0]) for t in built], dict.fromkeys(langs, 1))
    most, add = [0], divergence._Slots.add
    monkeypatch.setattr(divergence, "DENSE", 5 * 8 * 300)

    def told(self, *args):
        out = list(add(self, *args) or ())
        most.append(self.bytes)
        return out

    monkeypatch.setattr(divergence._Slots, "add", told)
    got, handed = Counter(), 0
    for out in divergence._recount(SimpleNamespace(value=tables))(iter([batch])):
        for r in out.to_pylist():
            handed += 1
            for slot, n in zip(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["n"], np.int64), strict=True):
                got[r["lang"], r["source"], tables[r["lang"]].keys[int(slot)].as_py()] += int(n)
    assert got == Counter((lang, source, w) for lang, source, text in rows for w in text.split())
    assert max(most) <= 5 * 8 * 300 and handed == 60  # each group once


def test_divergence_of_nothing(spark):
    assert divergence.divergences(frame(spark).where("false")).count() == 0
    nulls = [(i, None, None, s, None, "c", 1, "p", "r") for i, s in enumerate(("a", "b", None))]
    got = {tuple(r) for r in divergence.divergences(frame(spark, nulls)).collect()}
    assert got == _divergence_oracle(nulls, 3, 200) and len(got) == 6


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 50, 8192, 30_000):
        h = X.mix(np.arange(n, dtype=np.uint64), 3)
        moves, slot = divergence.perfect_hash(h)
        assert sorted(slot.tolist()) == list(range(n))
        move = moves[((h >> np.uint64(32)) % np.uint64(divergence._buckets(n))).astype(int)].astype(np.int64)
        assert (np.where(move < 0, -1 - move, divergence._spot(h, np.maximum(move, 0), n)) == slot).all()


def test_share_is_exact(spark):
    pairs = [(1, 3), (2, 3), (3, 3), (10**15 - 1, 10**15), (123456789012345, 8 * 10**15), (1, 8 * 10**15)]
    got = spark.createDataFrame(pairs, "c long, d long").select("c", "d", divergence.share(F.col("c"), F.col("d")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.c // r.d for r in got)
    c, d = (np.array(x) for x in zip(*pairs, strict=True))
    assert divergence._share(c, d).tolist() == [1 + 10**9 * a // b for a, b in pairs]


# ---- manifest ----------------------------------------------------------------------------------


def _h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def _leaf(r, text):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def _tree(level):
    """Root, and for each leaf what stands left and right of it and its ancestors."""
    sides, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k // 8 * 8
            sides[i].append(("".join(level[run:k]), "".join(level[k + 1 : run + 8])))
            at[i] = k // 8
        level = [_h(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], sides


def _manifest_oracle(rows):
    langs, out, subroots = defaultdict(list), [], {}
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        subroots[lang] = _tree([_leaf(r, r[1]) for r in langs[lang]])
    root, above = _tree([subroots[x][0] for x in order])
    for lang, top in zip(order, above, strict=True):
        for r, sides in zip(langs[lang], subroots[lang][1], strict=True):
            sides, leaf = sides + top, _leaf(r, r[1])
            tampered = r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            folded = _leaf(r, _lower(r[1])) if tampered else leaf
            for a, b in sides:
                folded = _h(a, folded, b)
            out.append((r[0], leaf, subroots[lang][0], root, _h(*(a + b for a, b in sides)), folded, folded == root))
    return Counter(out)


def _manifest(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return Counter(tuple(r) for r in manifest.manifest(df, tampered, F.translate("text", manifest.UPPER, manifest.LOWER)).collect())


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "SPAN", manifest.FAN**levels)
    rng = random.Random(3)
    rows = documents() + documents() + EDGES + EDGES[:2]
    rows += [(5000 + i, prose(rng, 3).title(), f"l{i % 11}", "s", i, "c", 1, "p", "r") for i in range(150)]
    rows += [(6000 + i, f"Text {i}", "big", None, i, "c", 1, "p", "r") for i in range(700)] + [(9999, "Word " * 600_000, "big", "s", 1, "c", 1, "p", "r")]
    got = _manifest(frame(spark, rows))
    assert got == _manifest_oracle(rows) and len({r[3] for r in got}) == 1 and {r[6] for r in got} == {True, False}


def test_small_manifests(spark):
    assert not _manifest(frame(spark).where("false"))
    for rows in ([EDGES[0]], [EDGES[0]] * 9, [EDGES[0], EDGES[2]]):
        assert _manifest(frame(spark, rows, 3)) == _manifest_oracle(rows)


# ---- simhash -----------------------------------------------------------------------------------


def _fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", _lower(text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fingerprints):
    """Of distinct fingerprints, by comparing all pairs."""
    fps, name = sorted(fingerprints), {}
    for f in fps:
        if f not in name:
            todo, name[f] = [f], f
            while todo:
                x = todo.pop()
                near = [y for y in fps if y not in name and (x ^ y).bit_count() <= 2]
                name.update(dict.fromkeys(near, f))
                todo += near
    return name


def test_simhash(spark):
    rng = random.Random(5)
    words = prose(rng, 400).split(" ")
    rows = documents() + EDGES
    for i in range(40):  # long texts with one word changed differ in few bits
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((7000 + i, " \t".join(words), "en", "s", 1, "c", 1, "p", "r"))
    rows += [(8000, "One two " * 300_000, "en", "s", 1, "c", 1, "p", "r"), (8000, "another text", "en", "s", 1, "c", 1, "p", "r")]
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    of, least = _components({_fingerprint(r[1]) for r in rows}), {}
    for r in rows:
        c = of[_fingerprint(r[1])]
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    want = Counter((r[0], _fingerprint(r[1]), least[of[_fingerprint(r[1])]]) for r in rows)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert len(set(of)) - len(set(of.values())) > 10
    assert simhash.simhash_groups(frame(spark).where("false")).count() == 0


@pytest.mark.parametrize("small", [1, 8, 512])
def test_links_are_complete_when_signatures_are_crowded(spark, monkeypatch, small):
    """Fingerprints around common halves, quarters and eighths: the buckets are cut to the last level."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(100)}
    fps |= {(0xDEADBEEF << 32) | rng.getrandbits(14) << 18 for _ in range(150)} | {(rng.getrandbits(12) << 40) | 0xABCD for _ in range(150)}
    for f in rng.sample(sorted(fps), 150):
        fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {0, 1 << 63, (1 << 64) - 1, (1 << 63) | 1}
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(rows, "fp long")).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() for r in edges)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges:
        a, b = root(r.a % (1 << 64)), root(r.b % (1 << 64))
        parent[max(a, b)] = min(a, b)
    assert {f: root(f) for f in fps} == _components(fps)
