"""Vectorised words and fingerprints of whole texts, on UTF-8 bytes.

Separators are ASCII in every word rule used here, so bytes can be split without decoding. A word's
fingerprint is a 64-bit polynomial of its bytes, mixed; a run of words has a 64-bit multilinear
fingerprint of its words' fingerprints, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators once A-Z are lower case: ASCII but for letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one step works on (more if a single text is longer).
STEP = 1 << 20
BASE, LENGTH = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) >= n:
        return _POWERS
    with np.errstate(over="ignore"):
        made = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 64) - 1, BASE))])
    if n <= 1 << 16:
        _POWERS = made
    return made


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if not len(a):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] and a.buffers()[2].size else np.zeros(0, np.uint8)
    return off, data


def steps(off: np.ndarray, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, at least a row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


class Words:
    """Words of some whole texts: byte ranges, fingerprints, and where each text's words begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray, sep: np.ndarray, lower: bool):
        self.seg = seg = data[off[0] : off[-1]]
        bounds = off - off[0]
        if lower:
            seg = LOWER[seg]
        self.low = seg
        mask = ~sep[seg]
        before, after = np.zeros_like(mask), np.zeros_like(mask)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        before[bounds[bounds < len(seg)]] = False
        after[bounds[bounds > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
        self.ptr = np.searchsorted(self.starts, bounds)
        lens = self.ends - self.starts
        if len(lens):
            first = np.cumsum(lens) - lens
            at = np.arange(int(lens.sum())) - np.repeat(first, lens)
            with np.errstate(over="ignore"):
                v = (seg[mask].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()) + 1)[at]
                self.hash = mix(np.add.reduceat(v, first) + lens.astype(np.uint64) * LENGTH)
        else:
            self.hash = np.zeros(0, np.uint64)
        self.counts = np.diff(self.ptr)

    def grams(self, k: int, seed: int) -> np.ndarray:
        """Fingerprints of the runs of ``k`` words that start at each word; runs over a text's end are among them, and none where fewer words follow."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        c = constants(k, seed)
        with np.errstate(over="ignore"):
            acc = self.hash[:n] * c[0]
            for j in range(1, k):
                acc += self.hash[j : n + j] * c[j]
            return mix(acc)


def worded(column: pa.Array, sep: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """The words of a column, in steps of about ``STEP`` bytes: first row, row after the last, words."""
    off, data = utf8(column)
    for lo, hi in steps(off):
        yield lo, hi, Words(data, off[lo : hi + 1], sep, lower)


def sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """``op`` over each ``w`` consecutive elements, in log(w) passes."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out
