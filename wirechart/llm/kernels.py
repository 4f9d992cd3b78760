"""Vectorised text kernels for use inside Arrow tasks: slabs of documents, words, rolling hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 19
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def frugal(task):
    """Wrap a generator of a task so that its worker gives freed memory back to the system at the end."""

    @functools.wraps(task)
    def run(*args, **named):
        yield from task(*args, **named)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; grows by doubling and is kept for later slabs."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, SLAB + 2)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 16 * SLAB:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x."""
    x, y = x >> np.uint64(30), x
    x ^= y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    y = x >> np.uint64(27)
    x ^= y
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=y)
    x ^= y
    return x


def slabs(texts: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts) for runs of whole documents of about ``limit`` bytes; a longer document is a run of its own."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8) if n else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def table(word: str) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte after lower-casing A-Z) for the two word rules: ``alnum`` and ``graph``."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    keep = np.ones(256, bool)
    if word == "alnum":
        keep[:128] = False
        keep[48:58] = keep[97:123] = keep[65:91] = True
    else:
        keep[[32, *range(9, 14)]] = False
    return keep, fold


def words(buf: np.ndarray, starts: np.ndarray, rule: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of the first word of each document and the number of all)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    keep, fold = rule
    inside = keep[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = starts[(starts > 0) & (starts < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[fold][buf] * _power(_MULT, n)[:n], out=sums[1:])
    hashed = (sums[end] - sums[begin]) * _power(_INV, n)[begin]
    return mix(hashed ^ (end - begin).astype(np.uint64)), np.searchsorted(begin, starts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive items, for the len - k + 1 places where they begin."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # runs of 1, 2, 4 .. items; those that add up to k are joined
    have, size, base, out, part = hashes, 1, _MULT, None, 0
    while True:
        if k & size:
            out = have if out is None else out[: len(have) - part] * np.uint64(base) + have[part:]
            part += size
        if size * 2 > k:
            return mix(out[:n])
        have = have[: len(have) - size] * np.uint64(base) + have[size:]
        size, base = size * 2, base * base & ((1 << 64) - 1)


def within(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of n places, those where k items begin that belong to one document; first: as from ``words``."""
    fits = np.zeros(n + 1, np.int32)
    lo, hi = first[:-1], np.maximum(first[1:] - k + 1, first[:-1])
    np.add.at(fits, np.minimum(lo, n), 1)
    np.add.at(fits, np.minimum(hi, n), -1)
    return np.cumsum(fits[:n]) > 0


def blocks(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` successive bytes by doubling; places whose block passes the end hold rubbish."""
    have, done, out, part = _BYTE[values], 1, None, 0
    base = _MULT
    n = len(values)
    while True:
        if width & done:
            if out is None:
                out, part = have.copy(), done
            else:
                moved = np.zeros(n, np.uint64)
                moved[: n - part] = have[part:] if part < n else have[:0]
                out = out * np.uint64(base & ((1 << 64) - 1)) + moved
                part += done
        done *= 2
        if done > width:
            return mix(out)
        moved = np.zeros(n, np.uint64)
        half = done // 2
        if half < n:
            moved[: n - half] = have[half:]
        have = have * np.uint64(base & ((1 << 64) - 1)) + moved
        base = base * base & ((1 << 64) - 1)


def minima(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive values, by doubling."""
    out, have = values, 1
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    if have < w:
        rest = w - have
        out = np.minimum(out[: len(out) - rest], out[rest:]) if len(out) > rest else out[:0]
    return out


def permutations(n: int, seed: int) -> np.ndarray:
    """Odd factors: x * factor modulo 2**32 is a bijection, so the least image is a MinHash value of mixed hashes."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(items: np.ndarray, first: np.ndarray, factors: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """MinHash values (uint32) of the runs of items that begin at ``first``, all of them with items: one row a run.

    A run goes on to the next one, or to ``end`` where items between two runs belong to none.
    """
    short = (items >> np.uint64(32)).astype(np.uint32)
    cuts = first if end is None else np.stack([first, end], axis=1).ravel()[:-1]
    out = np.empty((len(factors), len(first)), np.uint32)
    scaled = np.empty_like(short)
    for j, factor in enumerate(factors):
        np.multiply(short, factor, out=scaled)
        least = np.minimum.reduceat(scaled, cuts)
        out[j] = least if end is None else least[::2]
    return np.ascontiguousarray(out.T)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting is faster here than the hashing of np.unique."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def alike(items: list[np.ndarray], first: list[np.ndarray], percent: int) -> np.ndarray:
    """Of pairs of sets, side a and side b each as items and where every set begins: 100 * intersection >= percent * union.

    At most 2048 pairs; elements are compared by 52 bits of their hashes.
    """
    n = len(first[0])
    # pair, then element, then side: one order serves both sets and what they share
    keys = np.empty(sum(map(len, items)), np.uint64)
    done = 0
    for side, (own, begin) in enumerate(zip(items, first)):
        part = keys[done : done + len(own)]
        np.right_shift(own, np.uint64(12), out=part)
        part <<= np.uint64(1)
        part |= np.repeat((np.arange(n, dtype=np.uint64) << np.uint64(53)) | np.uint64(side), np.diff(np.append(begin, len(own))))
        done += len(own)
    keys = distinct(keys)
    edges = np.append(np.searchsorted(keys, np.arange(n, dtype=np.uint64) << np.uint64(53)), len(keys))
    shared = np.zeros(len(keys) + 2, np.int64)
    np.cumsum((keys[1:] ^ keys[:-1]) == 1, out=shared[2 : len(keys) + 1])
    inter = shared[edges[1:]] - shared[edges[:-1]]
    union = np.diff(edges) - inter
    return (union > 0) & (100 * inter >= percent * union)


def binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def pieces(values: np.ndarray, cuts: np.ndarray, some: np.ndarray | None = None) -> pa.Array:
    """The stretches of values between cuts as an Arrow column of bytes; null where ``some`` is false."""
    values = np.ascontiguousarray(values)
    width = values.nbytes // max(1, len(values))
    known = None if some is None else pa.array(some).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [known, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(values.tobytes())])


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))
