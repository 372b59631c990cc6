"""Whole Arrow text columns as flat numpy arrays.

Every text operator of this subpackage reads its rows through these helpers: a
batch is cut into blocks of whole documents (about ``BLOCK_BYTES`` of text, or one
longer document), words become start/end offsets, and words or windows of words
become 64-bit polynomial hashes taken from prefix sums, so no Python object is
made for a word. Nulls count as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown on demand and kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 2 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalising 64-bit mixer (bijective for one seed)."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64), 1000 + seed)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    data, offs = flat(column)
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at row borders."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends


def segment_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for each segment; equal for equal segments anywhere."""
    n = len(codes)
    up, down = powers(_BASE, n + 1), powers(_BASE_INV, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of codes[i:i+k] for every i with a whole window (rows are not minded here)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_BASE, len(codes) + 1), powers(_BASE_INV, n)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    h = total[k:] - total[:n]
    h *= down
    return mix(h + np.uint64(k))


def words(data: np.ndarray, offs: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each row the index of its first word (n+1 values)."""
    starts, ends = runs(in_word[data], offs)
    return starts, ends, np.searchsorted(starts, offs)


#: Bytes that are no white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Digits, a-z and everything past ASCII, after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def window_rows(first: np.ndarray, k: int) -> np.ndarray:
    """True for each token whose k-token window stays inside its row (first: n+1 row starts)."""
    n = int(first[-1])
    ok = np.ones(n, bool)
    if k > 1:
        near = first[1:, None] - np.arange(1, k)[None, :]
        near = near[near >= first[:-1, None]]
        ok[near] = False
    return ok


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """True for each of n tokens inside some window [s, s+k)."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + k, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
