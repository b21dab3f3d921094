"""Words of many texts at once, as numpy arrays over Arrow string buffers.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return. All of these are ASCII, so scanning UTF-8 bytes
gives the same words as scanning characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\v\f\r"
# Texts are scanned in slices of this many bytes, which bounds the working memory.
SLICE_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_IS_CORE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2 ** 64, at least n of them."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have


@dataclass
class Words:
    """Words of the texts ``first .. first + len(offsets) - 2`` of a column.

    Text i has the words offsets[i] .. offsets[i + 1]; starts and ends are byte
    positions inside ``data``; text i is data[base[i] : stops[i]].
    """

    first: int
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    base: np.ndarray
    stops: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def _without_tails(part: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words with ASCII punctuation behind an ASCII letter or digit at their end become two."""
    last = np.maximum.accumulate(np.where(_IS_CORE[part], np.arange(len(part)), -1))[ends - 1] + 1
    cut = np.flatnonzero((last > starts) & (last < ends) & (part[last - 1] < 128))
    return np.insert(starts, cut + 1, last[cut]), np.insert(ends, cut, last[cut])


def _scan(data: np.ndarray, lo: int, hi: int, cuts: np.ndarray, fold: np.ndarray, tails: bool):
    """Hash, start and end of each word in data[lo:hi]; no word crosses a cut."""
    part = data[lo:hi]
    inside = ~_IS_SPACE[part]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > lo) & (cuts < hi)] - lo
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    if tails:
        starts, ends = _without_tails(part, starts, ends)
    sums = np.empty(len(part) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[fold[part]] * _powers(_BASE, len(part))[: len(part)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(part))[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts + lo, ends + lo


def _word_safe_cuts(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Parts of one long text, each ending before white space."""
    while lo < hi:
        end = min(hi, lo + SLICE_BYTES)
        while end < hi:
            spaces = np.flatnonzero(_IS_SPACE[data[end : end + 4096]])
            if len(spaces):
                end += int(spaces[0])
                break
            end = min(hi, end + 4096)
        yield lo, end
        lo = end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and bytes; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at, np.frombuffer(data, np.uint8)


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most SLICE_BYTES together, or one longer text alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(texts: pa.Array, lower: bool = False, tails: bool = False) -> Iterator[Words]:
    """The words of a column of texts, slice by slice.

    ``lower`` folds A-Z only. With ``tails`` the ASCII punctuation that closes a word
    behind an ASCII letter or digit is a word of its own.
    """
    offsets, data = buffers(texts)
    fold = _LOWER if lower else _AS_IS
    for lo, hi in slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        cuts = offsets[lo : hi + 1]
        parts = [(a, b)] if b - a <= SLICE_BYTES else _word_safe_cuts(data, a, b)
        found = [_scan(data, x, y, cuts, fold, tails) for x, y in parts] or [_scan(data, a, a, cuts, fold, tails)]
        hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        at = np.searchsorted(starts, cuts)
        at[-1] = len(starts)
        yield Words(lo, at, hashes, starts, ends, data, cuts[:-1], cuts[1:])


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words of one text; all its words if it has fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + hashes[k : n - size + 1 + k]
        out = mix(out)
    return out
