"""Whole-column numpy helpers shared by the text operators.

Everything here works on the concatenated UTF-8 bytes of an Arrow batch and a
vector of document offsets, so that no per-row or per-word Python code runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once inside a task; one longer document forms a slice of its own.
SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20260101)
#: A random odd 64-bit value per byte, so that hashes of words depend on every bit.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 20), base, np.uint64)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        _powers[int(base)] = have = grown
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Hashes of any range of a sequence of 64-bit symbols in constant time each."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(_BASE, n), out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * powers(_INVERSE, len(self.sums))[start]
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def every(self, length: int) -> np.ndarray:
        """Hashes of all ranges of one length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:-length]) * powers(_INVERSE, n) + np.uint64(length * 0xD1B54A32D192ED03 % 2**64))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """Row ranges of about `size` bytes each; no row is split."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Words `[^\\x20\\x09-\\x0D]+` of each document.

    Returns starts and ends of all words, their hashes, and the offsets of the
    documents' words. A word never crosses a document's end.
    """
    n = len(data)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    shuts = solid.copy()
    shuts[:-1] &= ~solid[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[edges] = solid[edges]
    edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    shuts[edges] = solid[edges]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    hashes = Spans(BYTE_CODE[data]).hash(starts, ends) if n else np.zeros(0, np.uint64)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row that each element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values, in three passes whatever w is."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def windows_within(offsets: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of one length that stay within a row."""
    sizes = np.maximum(0, np.diff(offsets) - length + 1)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(offsets[:-1] - before, sizes)
