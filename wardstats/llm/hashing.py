"""NumPy helpers that run inside tasks on Arrow batches: words, their 64-bit
hashes and shingle sets of many texts at once, without a Python loop per word.

Words are compared by 64-bit hashes (two different ones agree with a chance
of about 5e-20 a pair)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that a task holds expanded at one time (a longer text alone).
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 & ~7 | 5)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _lower() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


LOWER = _lower()
_BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = ((n >> 17) + 1) << 17  # the tables stay in each worker
        for key, b in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(m, b, _U)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    out = _powers["up"][:n], _powers["down"][:n]
    if n > 4 * SLICE_BYTES:  # don't keep the tables of one very long text
        _powers.clear()
    return out


class Texts:
    """Consecutive texts as one byte array: ``data`` and the ``offsets`` of
    each text (null texts are empty)."""

    def __init__(self, column: pa.Array):
        if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
            column = column.cast(pa.string())
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, off, data = column.buffers()
        off = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if off is not None else np.zeros(len(column) + 1, np.int64)
        if column.null_count:
            size = np.diff(off) * np.asarray(column.is_valid())
            if size.sum() != off[-1] - off[0]:  # bytes below null slots: lay the texts out anew
                column = pa.array([x or "" for x in column.to_pylist()], pa.string())
                self.__init__(column)
                return
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = whole[off[0]:off[-1]], off - off[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` text bytes (one
    row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = Texts(col).offsets[1:]
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def words(texts: Texts, separator: np.ndarray = SPACE, lower: bool = True, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word of all texts, and the index
    of each text's first word (one more at the end). A word is a maximal run
    of bytes outside ``separator`` within one text; with ``kinds`` (a number
    for each byte value) a run also ends where two kinds above 0 meet."""
    data, off = texts.data, texts.offsets
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~separator[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    if kinds is not None and n:
        kind = kinds[data]
        cut[1:n] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_CODE[LOWER[data] if lower else data] * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
    return h, start, end, np.searchsorted(start, off)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive word hashes (also across texts)."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, _U)
    for i in range(k):
        out = mix(out * _U(0x9FB21C651E98DF25) + h[i:i + n]) if k < 3 else out * _U(0x9FB21C651E98DF25) + h[i:i + n] * _U(2 * i + 1)
    return mix(out)


def shingle_sets(texts: Texts, k: int, weigh=None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The sorted distinct k-word shingles of each text; a text with fewer
    words has its whole sequence as one, a text without words none. ``weigh``
    (numbers for word hashes) adds the sum of each shingle's words."""
    h, _, _, first = words(texts)
    g = grams(h, k)
    if weigh is not None:
        w = np.concatenate([[0], np.cumsum(weigh(h))])
        sums = w[k:] - w[:-k]
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            if weigh is None:
                yield np.unique(g[a:b - k + 1]), None
            else:
                s, at = np.unique(g[a:b - k + 1], return_index=True)
                yield s, sums[a + at]
        elif b > a:
            yield grams(h[a:b], int(b - a)) ^ _U(0x5851F42D4C957F2D), None if weigh is None else w[[b]] - w[a]
        else:
            yield np.zeros(0, _U), None if weigh is None else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark longs, bit for bit."""
    return x.view(np.int64)
