"""Words of Arrow string columns as 64-bit hashes, without Python strings.

A word is a run of bytes outside [\\x20\\x09-\\x0D]. Its hash is a polynomial over random byte values
modulo 2 ** 64, taken from prefix sums, and mixed. All work is on blocks of bounded size, so a very
long text needs no more memory than its bytes and eight bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK = 1 << 18
_rng = np.random.default_rng(20240229)
_BASE = U64(0x9E3779B97F4A7C13)  # odd, and 3 modulo 8
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, _BASE)]), dtype=U64)
            _inv = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, inverse)]), dtype=U64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hash_words(column: pa.Array | pa.ChunkedArray, lower: bool = False, spans: bool = False):
    """(hashes, first): all words in order, and the index of each text's first word (one more at the end).

    With spans also (data, starts, ends): the bytes, and each word's place in them.
    """
    data, at = buffers(column)
    table = _LOWER if lower else _TABLE
    hashes, starts, ends = [], [], []
    a, total = 0, len(data)
    while a < total:
        b = min(a + BLOCK, total)
        if b < total and not _SPACE[data[b - 1]]:
            # end the block where a word ends: at a space, or between two texts
            space = np.flatnonzero(_SPACE[data[a:b]])
            cut = max(a + int(space[-1]) + 1 if len(space) else a, int(at[np.searchsorted(at, b, "right") - 1]))
            while cut <= a:  # a word longer than the block
                nxt = min(b + BLOCK, total)
                space = np.flatnonzero(_SPACE[data[b:nxt]])
                later = int(at[np.searchsorted(at, b, "left")])
                cut = min(b + int(space[0]) + 1 if len(space) else (nxt if nxt == total else total + 1), later)
                if cut > nxt:
                    b, cut = nxt, a
            b = cut
        seg = data[a:b]
        inside = ~_SPACE[seg]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = at[np.searchsorted(at, a, "right") : np.searchsorted(at, b, "left")] - a
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        p, q = _powers(len(seg) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(seg) + 1, U64)
            np.cumsum(table[seg] * p[: len(seg)], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * q[s]))
        starts.append(s + a)
        if spans:
            ends.append(e + a)
        a = b
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    first = np.searchsorted(s, at, "left")
    if spans:
        return h, first, data, s, np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return h, first


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (none if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out = out * _BASE + h[i : n + i]
        return mix(out)
