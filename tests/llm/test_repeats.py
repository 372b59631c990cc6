"""Passage and string dedup against brute force, over one block and over many."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from courtline.llm import blocked, passages, substrings, suffixes

from .common import documents, frame, spaced


@pytest.fixture(params=[2 << 20, 3000])
def block_size(request, monkeypatch):
    monkeypatch.setattr(blocked, "MIN_BLOCK", request.param)
    return request.param


def _first(rows, units, n):
    first = {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        u = units(text)
        for k in range(len(u) - n + 1):
            first.setdefault(tuple(u[k : k + n]), doc)
    return first


def _cut(u, first, doc, n):
    cut = [False] * len(u)
    for k in range(len(u) - n + 1):
        if first[tuple(u[k : k + n])] < doc:
            cut[k : k + n] = [True] * n
    return cut


def test_passages(spark, block_size):
    rows = documents()
    first = _first(rows, spaced, 13)
    want = []
    for doc, text, *_ in rows:
        u = spaced(text)
        cut = _cut(u, first, doc, 13)
        want.append((doc, len(u), sum(cut), b" ".join(w for w, c in zip(u, cut) if not c).decode()))
    got = [tuple(r) for r in passages.remove_repeated_passages(frame(spark)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[2] for r in got) > 100


def test_strings(spark, block_size):
    rows = documents(3)
    units = lambda t: (t or "").encode()
    first = _first(rows, units, 50)
    want = []
    for doc, text, *_ in rows:
        u = units(text)
        cut = _cut(u, first, doc, 50)
        spans = sum(c and (k == 0 or not cut[k - 1]) for k, c in enumerate(cut))
        want.append((doc, len(u), sum(cut), spans, bytes(b for b, c in zip(u, cut) if not c)))
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in substrings.remove_repeated_strings(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_no_rows_and_no_ids(spark):
    empty = frame(spark).where("false")
    assert passages.remove_repeated_passages(empty).count() == 0
    assert substrings.remove_repeated_strings(empty).count() == 0
    rows = [(None, "a b c " * 40, *r[2:]) for r in documents()[:2]] + [(1, "a b c " * 40, *documents()[0][2:])]
    assert [r.n_removed for r in passages.remove_repeated_passages(frame(spark, rows)).collect()] == [0, 0, 0]
    assert [r.n_removed for r in substrings.remove_repeated_strings(frame(spark, rows)).collect()] == [0, 0, 0]


def test_many_surroundings_of_one_anchor(spark, monkeypatch):
    monkeypatch.setattr(substrings, "ROWS_PER_ARRAY", 4)
    rng = random.Random(1)
    line = "this very common line stands in a third of all documents, with other words around it"
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [noise(rng.randint(0, 60)) + line + noise(rng.randint(0, 60)) for _ in range(40)]
    rows = [(i, t, *documents()[0][2:]) for i, t in enumerate(texts)]
    first = _first(rows, str.encode, 50)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeated_strings(frame(spark, rows)).collect()}
    assert got == {i: sum(_cut(t.encode(), first, i, 50)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("hot", [0, 8])
def test_strings_around_hot_anchors(spark, block_size, hot):
    rows = documents(3)
    rows += [(5000 + i, f"{i:03d} {i * i}" * 3 + "a common line that stands in very many of all the documents here" + f"{i * 7} {i:04d}" * 4, *rows[0][2:]) for i in range(60)]
    units = lambda t: (t or "").encode()
    first = _first(rows, units, 50)
    want = [(r[0], sum(_cut(units(r[1]), first, r[0], 50))) for r in rows]
    got = [(r.doc_id, r.n_removed) for r in substrings.remove_repeated_strings(frame(spark, rows), hot=hot).collect()]
    assert sorted(got) == sorted(want)


def test_surroundings_of_a_hot_anchor_are_dealt_over_buckets():
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line = "this very common line stands in all documents, with other words around it every time"
    tables = [pa.table({"doc_id": range(1000 * b, 1000 * b + 1000), "text": [noise(40) + line + noise(40) for _ in range(1000)]}) for b in range(4)]
    n_anchor, n_text, n_hot = 16, 16, 16
    asked = pa.concat_tables([substrings._ask_anchors(n_anchor)((pa.scalar(b),), t) for b, t in enumerate(tables)])
    answer = substrings._answer_anchors(500)
    shared = pa.concat_tables([answer(asked.filter(pc.equal(asked["bucket"], k))) for k in pc.unique(asked["bucket"]).to_pylist()])
    asked = pa.concat_tables([substrings._ask_strings(n_anchor, n_text, n_hot)((pa.scalar(b),), t, shared.filter(pc.equal(shared["blk"], b))) for b, t in enumerate(tables)])
    cold, hot = Counter(), Counter()
    for bucket, payload in zip(asked["bucket"].to_pylist(), asked["payload"].to_pylist(), strict=True):
        n = int(np.frombuffer(payload, np.int32, 1)[0])
        if bucket < n_text:
            around = pa.decompress(payload[4:], n * substrings._ENTRY, codec="zstd", asbytes=True)
            width, reach = substrings.WIDTH, substrings.REACH
            cold.update(around[k * width + reach : k * width + substrings.SPAN] for k in range(n))
        else:
            hot[bucket] += n
    assert max(cold.values()) <= 500  # all of an anchor's rows are in one bucket; before, those of a border were 4,000
    assert sum(hot.values()) > 4000 and max(hot.values()) < 1.5 * sum(hot.values()) / n_hot


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_lyndon_groups(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        rows = [rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)).tolist() for _ in range(rng.integers(1, 9))]
        text = [0] + [c for r in rows for c in (*r, 0)]
        order, group = suffixes.suffix_array(np.array(text))
        end = [text.index(0, i) for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: (text[i : end[i]], end[i]))
        lyndon = {}
        for i in range(len(text)):
            if text[i]:  # the longest prefix that is less than all its own suffixes ends before the next smaller suffix
                below = [j for j in range(i + 1, end[i]) if text[j : end[j]] < text[i : end[i]]]
                lyndon[i] = tuple(text[i : below[0] if below else end[i]])
        by_group = {}
        for i, word in lyndon.items():
            by_group.setdefault(int(group[i]), set()).add(word)
        assert all(len(words) == 1 for words in by_group.values())
        assert [min(by_group[g]) for g in sorted(by_group)] == sorted(set(lyndon.values()))


def test_suffix_array_of_long_rows():
    rng = np.random.default_rng(9)
    for row in (np.tile([1, 2, 1], 400), np.ones(1500, int), rng.integers(1, 3, 1500)):
        order, _ = suffixes.suffix_array(np.r_[0, row, 0])
        raw = bytes(row.astype(np.uint8).tolist())
        assert (order[2:] - 1).tolist() == sorted(range(len(row)), key=lambda i: raw[i:])
    assert len(suffixes.suffix_array(np.zeros(0, int))[0]) == 0


def test_blocks_hold_equal_shares_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(blocked, "MIN_BLOCK", 4000)
    rng = random.Random(3)
    ids = [10**12 + i for i in range(600)] + [5 * 10**15 + 7 * i for i in range(600)] + list(range(0, 10**9, 10**7))  # clustered
    rows = [(i, "x" * (3000 if k % 50 == 0 else rng.randint(0, 200)), *documents()[0][2:]) for k, i in enumerate(ids)]
    for cells in (128, 8):  # with and without cuts inside cells
        monkeypatch.setattr(blocked, "CELLS", cells)
        dealt, n, size = blocked.deal(frame(spark, rows))
        got = dealt.collect()
        assert size == sum(len(r[1]) for r in rows) and {r.blk for r in got} <= set(range(n)) and len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.blk, []).append(r)
        assert n >= size / 4000 and max(sum(len(r.text) for r in b) for b in by.values()) <= 3 * 4000
        assert all(max(r.doc_id for r in by[a]) < min(r.doc_id for r in by[b]) for a, b in zip(sorted(by), sorted(by)[1:]))
    dealt, n, size = blocked.deal(frame(spark, [(7, "x" * 300, *rows[0][2:])] * 40))
    assert {r.blk for r in dealt.collect()} == {0}


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(400_000))  # over one block of bytes
    tail = long[-3000:]
    rows = [(1, long, *documents()[0][2:]), (2, "before " + tail, *documents()[0][2:]), (3, "q" * 3_000_000, *documents()[0][2:])]
    got = {r.doc_id: r for r in passages.remove_repeated_passages(frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[1].n_words, got[3].n_words) == (0, 400_000, 1) and got[2].n_removed >= len(tail.split()) - 1
    got = {r.doc_id: r for r in substrings.remove_repeated_strings(frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (0, 3000, 0) and bytes(got[2].kept).rstrip() == b"before"
