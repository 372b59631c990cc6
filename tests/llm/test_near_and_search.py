"""Near-duplicate join, benchmark search, word pieces and packing against brute force."""

import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from courtline.llm import decontaminate, nearjoin, packing, saved, wordpieces

from .common import alnum, documents, frame, spaced


def _shingles(text):
    w = alnum(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("tile", [256, 3])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(nearjoin, "TILE", tile)
    monkeypatch.setattr(nearjoin, "SMALL", tile)
    monkeypatch.setattr(saved, "FEW", tile)
    rows = documents(5)
    sets = {r[0]: _shingles(r[1]) for r in rows}
    links = {a: {b for b in sets if b != a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in sets}
    classes = {}
    for a in sorted(sets):
        todo = [] if a in classes else [a]
        while todo:
            b = todo.pop()
            if b not in classes:
                classes[b] = a
                todo += links[b]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.near_duplicates(frame(spark, rows)).collect()}
    assert got == {a: (classes[a], len(links[a])) for a in sets}
    assert max(n for _, n in got.values()) >= 2


def test_near_duplicates_of_nothing(spark):
    assert nearjoin.near_duplicates(frame(spark).where("false")).count() == 0
    assert [tuple(r)[:3] for r in nearjoin.near_duplicates(frame(spark, [(1, None, *documents()[0][2:])])).collect()] == [(1, 1, 0)]


@pytest.mark.parametrize("item_bytes", [1 << 24, 60])
def test_benchmark_matches(spark, monkeypatch, item_bytes):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    rows = documents(7)
    long = next(r[1] for r in rows if r[1] and len(alnum(r[1])) > 60)
    items = [(1, " ".join(long.split(" ")[5:30]).upper()), (2, "edited"), (3, None), (4, ""), (5, "A b, C D"), (None, "aa aa aa"), (20, " ".join(long.split(" ")[12:40])), (20, "x y z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = []
    for doc, text, *_ in rows:
        w, hit, found = alnum(text), set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= names
        want.append((doc, len(w), len(hit), sorted(found)))
    got = [tuple(r)[:4] for r in decontaminate.benchmark_matches(frame(spark, rows), bench).collect()]
    assert sorted(got) == sorted(want)
    bad = {r[0] for r in want if r[2]}
    kept = decontaminate.decontaminate(frame(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in bad) and "blk" in kept.columns
    assert decontaminate.benchmark_matches(frame(spark, rows), bench.where("false")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_every_item_suffix_finds_its_longest_match_and_all_its_places(seed):
    rng = np.random.default_rng(seed)
    words = lambda n, k: [f"w{x}" for x in rng.integers(0, k, n)]
    k = int(rng.integers(2, 30))
    docs = [words(int(rng.integers(0, 60)), k) for _ in range(12)]
    docs += [docs[0], docs[1] + docs[0], ["w0"] * 70]
    items = [words(int(rng.integers(0, 30)), k) for _ in range(6)] + [docs[2][:25], ["w0"] * 12, ["no", "w0"]]
    span = 4
    block = decontaminate.item_block([str(i) for i in range(len(items))], [" ".join(x) for x in items], span)
    codes, first = decontaminate._word_codes(pa.array([" ".join(d) for d in docs]))
    known = np.searchsorted(block["vocabulary"], codes)
    known[known == len(block["vocabulary"])] = 0
    number = np.where(block["vocabulary"][known] == codes, known + 1, 0)
    row = np.searchsorted(first, np.arange(len(codes)), side="right") - 1
    end = np.array([next((j for j in range(i, first[row[i] + 1]) if number[j] == 0), first[row[i] + 1]) for i in range(len(codes))])
    order = decontaminate.suffix_order(number, end)
    names = [number[i : end[i]].tolist() for i in order]
    assert sorted(order.tolist()) == np.flatnonzero(number).tolist() and names == sorted(names)
    length, low, high, *_ = decontaminate.search_suffixes(number, end, order, block)
    j = 0
    for item in items:
        for a in range(len(item)):
            common = [next((d for d in range(len(item) - a) if p + d >= end[p] or codes[p + d] != block["vocabulary"][block["number"][j + d] - 1]), len(item) - a) for p in range(len(codes))]
            most = max(common)
            assert length[j] == most
            if most:
                assert sorted(order[low[j] : high[j]].tolist()) == [p for p, c in enumerate(common) if c == most]
            j += 1
    _, found = decontaminate.search_shard(codes, first, block)
    got = {(int(r), int(i)): int(m) for r, i, m in zip(found["row"], found["item"], found["n"], strict=True)}
    want = {}
    for r, d in enumerate(docs):
        for i, item in enumerate(items):
            runs = [next((e for e in range(min(len(d) - x, len(item) - y)) if d[x + e] != item[y + e]), min(len(d) - x, len(item) - y)) for x in range(len(d)) for y in range(len(item))]
            if max(runs, default=0) >= min(span, max(1, len(item))):
                want[r, i] = max(runs)
    assert got == want


def test_a_task_holds_one_block_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    bench = spark.createDataFrame([(i, f"item {i} of the benchmark") for i in range(20)], "item_id long, text string")
    docs = frame(spark, [(1, "an item 3 of the benchmark and item 4 of the benchmark", *documents()[0][2:])] * 2)
    found = decontaminate.benchmark_matches(docs, bench)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow search") == 5  # one scan a block; before, one scan held all
    assert [(r.n_words, r.n_hit, r["items"]) for r in found.collect()] == [(12, 10, ["3", "4"])] * 2


def test_longest_match_is_joined(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = frame(spark, [(1, "q " + text + " q", *documents()[0][2:])])
    got = decontaminate.benchmark_matches(docs, spark.createDataFrame([(9, text)], "item_id long, text string")).first()
    assert [tuple(m) for m in got.matches] == [("9", 1, 0, 50)]


def test_word_pieces(spark):
    begin, go_on = [b"a", b"ab", b"abc", b"t", b"the", b"\xe6\x97\xa5"], [b"b", b"bcd", b"c", b"cd", b"d", b"e", b"h", b"e\xc3\xa9"]
    machine = wordpieces.automaton(begin, go_on)

    def greedy(word):
        n = i = 0
        while i < len(word):
            size = max((len(p) for p in (go_on if i else begin) if word.startswith(p, i)), default=0)
            if not size:
                return 0
            n, i = n + 1, i + size
        return n

    rng = np.random.default_rng(0)
    found = [rng.choice(list(b"abcdeth"), rng.integers(1, 12)).astype(np.uint8).tobytes() for _ in range(2000)] + ["日a".encode(), "日é".encode(), b"abceeeee" * 50]
    ends = np.cumsum([len(w) for w in found])
    got = wordpieces.piece_counts(np.frombuffer(b"".join(found), np.uint8), ends - [len(w) for w in found], ends, machine)
    assert got.tolist() == [greedy(w) for w in found] and got.max() > 5
    rows = wordpieces.token_counts(frame(spark), (begin, go_on)).collect()
    counts = {(r[0], r[1]): [greedy(w) for w in spaced(r[1])] for r in documents()}
    assert Counter((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in rows) == Counter((d, len(c), sum(max(1, x) for x in c), sum(x == 0 for x in c)) for d, c in [(r[0], counts[(r[0], r[1])]) for r in documents()])


def test_long_words_cost_time_in_proportion(spark, monkeypatch):
    begin, go_on = [b"a", b"ab", b"abc", b"t"], [b"b", b"bcd", b"c", b"cd", b"d", b"a"]
    rng = np.random.default_rng(1)
    words = [rng.choice(list(b"abcd"), rng.integers(1, 60)).astype(np.uint8).tobytes() for _ in range(500)]
    ends = np.cumsum([len(w) for w in words])
    args = np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends
    want = wordpieces.piece_counts(*args, wordpieces.automaton(begin, go_on))
    monkeypatch.setattr(wordpieces, "LONG", 5)
    assert wordpieces.piece_counts(*args, wordpieces.automaton(begin, go_on)).tolist() == want.tolist()
    monkeypatch.undo()
    begun = time.monotonic()
    got = wordpieces.token_counts(frame(spark, [(1, "a" * 5_000_000, *documents()[0][2:])], 1), (begin, go_on)).first()
    assert (got.n_words, got.n_tokens) == (1, 5_000_000) and time.monotonic() - begun < 60


def test_packing(spark):
    rows = documents(9)
    got = packing.pack_documents(frame(spark, rows), 64).collect()
    length = Counter()
    for r in rows:
        length[r[0]] += len(spaced(r[1]))
    assert Counter({d: sum(r.n_words for r in got if r.doc_id == d) for d in length}) == length
    source, words = {r[0]: r[3] or "" for r in rows}, {r[0]: " ".join(w.decode().translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})) for w in spaced(r[1])) for r in rows}
    bins = defaultdict(list)
    for r in got:
        assert (r.bin_id is None) == (r.n_words == 0)
        if r.n_words:
            bins[r.bin_id].append(r)
    for own in bins.values():
        assert sum(r.n_words for r in own) <= 64
        assert len({source[r.doc_id] for r in own}) == len(own) and len({words[r.doc_id] for r in own}) == len(own)
        at = 0
        for r in sorted(own, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
    assert packing.pack_documents(frame(spark).where("false")).count() == 0


def test_packing_keeps_near_copies_apart(spark):
    text = " ".join(f"word{k}" for k in range(90))
    near = [text, text.replace("word89", "changed"), text.replace("word0 ", "first "), text + " more"]
    other = [" ".join(f"{name}{k}" for k in range(90)) for name in "abcd"]
    ids = [1, 2, None, 4, 5, 5, None, 8]  # 5 has two different texts, one of them a near copy
    texts = [near[0], near[1], near[2], other[0], other[1], near[3], other[2], other[3]]
    rows = [(d, t, "en", f"src{i}", len(t), "clash", 1, "p", "r") for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    got = packing.pack_documents(frame(spark, rows), 1024).collect()
    bins = Counter(r.bin_id for r in got)
    assert len(got) == 8 and len(bins) == 4  # the four near copies each in another bin
    pieces = sorted((r.doc_id or 0, r.n_words, r.bin_id) for r in got)
    ones = [b for d, n, b in pieces if (d, n) in {(1, 90), (2, 90), (5, 91)}]
    assert len(ones) == 3 == len(set(ones))


def test_best_fit_takes_the_tightest_compatible_bin():
    # 10 opens bin 0 (room 6), 9 bin 1 (room 7); 6 of the same source as bin 0 must go to bin 1
    assert packing.best_fit([10, 9, 6], [1, 2, 1], [0, 0, 0], 16) == [0, 1, 1]
    assert packing.best_fit([10, 9, 6], [1, 2, 4], [0, 0, 0], 16) == [0, 1, 0]
    assert packing.best_fit([10, 9, 6], [1, 2, 4], [1, 0, 1], 16) == [0, 1, 1]


def test_each_piece_goes_to_the_tightest_compatible_bin_that_a_plain_search_finds():
    rng = np.random.default_rng(4)
    for capacity, n, n_sources, n_clusters in ((16, 300, 40, 60), (50, 300, 8, 9), (7, 200, 200, 3)):
        lengths = sorted(rng.integers(1, capacity + 1, n).tolist(), reverse=True)
        sources, clusters = rng.integers(0, n_sources, n).tolist(), rng.integers(-n_clusters, n_clusters, n).tolist()
        got = packing.best_fit(lengths, [1 << s for s in sources], [1 << c if c >= 0 else 0 for c in clusters], capacity)
        room, held = {}, {}
        for size, source, cluster, where in zip(lengths, sources, clusters, got, strict=True):
            fits = [r for b, r in room.items() if r >= size and source not in held[b][0] and (cluster < 0 or cluster not in held[b][1])]
            if where in room:
                assert room[where] in fits and room[where] == min(fits)
            else:
                assert not fits and where == len(room)
                room[where], held[where] = capacity, (set(), set())
            room[where] -= size
            held[where][0].add(source)
            held[where][1].add(cluster)


def test_recall_with_split_buckets(spark, monkeypatch):
    """Near copies whose buckets are large and are split on further tokens: every link of a brute-force comparison is found."""
    monkeypatch.setattr(nearjoin, "SMALL", 8)
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(12):  # groups about the threshold that share a frequent passage
        own = [f"v{x}" for x in rng.integers(0, 10**6, 120)]
        for _ in range(12):
            words = list(own)
            for k in rng.choice(120, int(rng.integers(0, 4)), replace=False):
                words[k] = f"u{rng.integers(0, 10**6)}"
            texts.append(" ".join(["the same five words begin every text here"] * 1 + words))
    sets = [_shingles(t) for t in texts]
    links = [sum(j != i and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = {r.doc_id: r.n_links for r in nearjoin.near_duplicates(frame(spark, [(i, t, *documents()[0][2:]) for i, t in enumerate(texts)])).collect()}
    assert sum(links) > 500 and sum(got.values()) == sum(links)
    assert nearjoin.RUNS == nearjoin.runs_for(nearjoin.RECALL) >= 8
