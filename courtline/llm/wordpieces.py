"""Token counts by a linear longest-match automaton.

The vocabulary is a trie of pieces that begin a word and a trie of pieces that continue one.
Each node has a failure link to the node where matching goes on after the longest pieces
inside it were taken, and the number of pieces taken on that way. A word is then read once,
byte by byte, and its greedy longest-match pieces are counted without being built. Distinct
words of a block are read in lockstep, one byte of each at a time; words of more than ``LONG``
bytes each on its own, so that a long unbroken run costs time in proportion to its length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as X

BEGIN, CONTINUE, NOWHERE = 0, 1, -1
LONG = 1024


def sentencepiece_vocabulary(path: str | None = None) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word and pieces that continue one, of a sentencepiece model file."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    begin, go_on = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece[0] == "▁":
            begin.append(piece[1:].encode())
        else:
            go_on.append(piece.encode())
    return begin, go_on


def automaton(begin: Iterable[bytes], go_on: Iterable[bytes]) -> dict[str, np.ndarray]:
    """Transitions (sorted keys node * 256 + byte, and targets), failure links and popped-token counts."""
    step: list[dict[int, int]] = [{}, {}]
    whole = [False, False]
    for root, pieces in ((BEGIN, begin), (CONTINUE, go_on)):
        for piece in pieces:
            at = root
            for c in piece:
                to = step[at].get(c)
                if to is None:
                    to = step[at][c] = len(step)
                    step.append({})
                    whole.append(False)
                at = to
            whole[at] |= at > CONTINUE
    fail, popped = [NOWHERE] * len(step), [0] * len(step)
    queue = deque((root, c, v) for root in (BEGIN, CONTINUE) for c, v in step[root].items())
    while queue:
        u, c, v = queue.popleft()
        if whole[v]:
            fail[v], popped[v] = CONTINUE, 1
        else:
            z, n = fail[u], popped[u]
            while z != NOWHERE and c not in step[z]:
                n += popped[z]
                z = fail[z]
            if z != NOWHERE:
                fail[v], popped[v] = step[z][c], n
        queue.extend((v, d, w) for d, w in step[v].items())
    keys = np.array([u * 256 + c for u, x in enumerate(step) for c in sorted(x)], np.int64)
    to = np.array([x[c] for x in step for c in sorted(x)], np.int32)
    return {"keys": keys, "to": to, "fail": np.array(fail, np.int32), "popped": np.array(popped, np.int32)}


def _long_word(word: bytes, machine: dict) -> int:
    """Pieces of one word, read with plain numbers."""
    if "step" not in machine:  # once per worker
        machine |= {"step": dict(zip(machine["keys"].tolist(), machine["to"].tolist(), strict=True)), "links": machine["fail"].tolist(), "pops": machine["popped"].tolist()}
    step, fail, popped = machine["step"], machine["links"], machine["pops"]
    at, count = BEGIN, 0
    for c in word:
        to = step.get(at << 8 | c)
        while to is None:
            if fail[at] == NOWHERE:
                return 0
            count += popped[at]
            at = fail[at]
            to = step.get(at << 8 | c)
        at = to
    while at != CONTINUE:
        if fail[at] == NOWHERE:
            return 0
        count += popped[at]
        at = fail[at]
    return count


def piece_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, machine: dict[str, np.ndarray]) -> np.ndarray:
    """Pieces of each word data[start:end]; 0 for a word that has no pieces."""
    far = np.flatnonzero(ends - starts > LONG)
    if len(far):
        count = np.zeros(len(starts), np.int64)
        near = np.setdiff1d(np.arange(len(starts)), far, assume_unique=True)
        count[near] = piece_counts(data, starts[near], ends[near], machine)
        count[far] = [_long_word(data[starts[i] : ends[i]].tobytes(), machine) for i in far.tolist()]
        return count
    keys, to, fail, popped = (machine[k] for k in ("keys", "to", "fail", "popped"))
    n, length = len(starts), ends - starts
    at, count, lost = np.full(n, BEGIN, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    by_length = np.argsort(-length, kind="stable")
    longer = np.searchsorted(-length[by_length], -np.arange(1, int(length.max(initial=0)) + 1), side="right")

    def follow(live: np.ndarray, key: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[place] == key if len(keys) else np.zeros(len(key), bool)
        at[live[ok]] = to[place[ok]]
        return live[~ok]

    def fall(live: np.ndarray) -> np.ndarray:
        out = fail[at[live]] == NOWHERE
        lost[live[out]] = True
        live = live[~out]
        count[live] += popped[at[live]]
        at[live] = fail[at[live]]
        return live

    for d, m in enumerate(longer.tolist()):
        live = by_length[:m]
        live = live[~lost[live]]
        while live.size:
            live = follow(live, at[live] * 256 + data[starts[live] + d])
            live = fall(live)
    live = np.flatnonzero(~lost & (at != CONTINUE))
    while live.size:
        live = fall(live)
        live = live[at[live] != CONTINUE]
    count[lost] = 0
    return count


def token_counts(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]] | None = None) -> DataFrame:
    """Greedy word-piece counts of every row of ``docs``; one row per row.

    Words are runs of bytes other than ASCII white space, case kept. The longest piece that
    begins a word is taken, then the longest that continues it, and so on; a word that can't be
    taken apart is one unknown token. Returns doc_id, n_words, n_tokens and n_unknown.

    Null, empty and blank texts have no words and no tokens. Rows that repeat a doc_id and rows
    without doc_id are counted each on their own. Other columns are not looked at. The vocabulary
    (default: the sentencepiece file of 32,000 pieces) is sent to all executors; it has a fixed size.
    """
    sent = docs.sparkSession.sparkContext.broadcast(automaton(*(vocabulary or sentencepiece_vocabulary())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, codes = sent.value, X.byte_codes(4)
        for batch in batches:
            for a, b, data, offs in X.blocks(batch.column(1)):
                starts, ends, first = X.words(data, offs, X.NOT_SPACE)
                _, at, inverse = np.unique(X.segment_hashes(codes[data], starts, ends), return_index=True, return_inverse=True)
                count = piece_counts(data, starts[at], ends[at], machine)
                unknown = np.r_[0, np.cumsum((count == 0)[inverse])][first]
                total = np.r_[0, np.cumsum(np.maximum(count, 1)[inverse])][first]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(total), pa.int64()), pa.array(np.diff(unknown), pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
