"""The distinct words of many texts, exactly, as Arrow dictionaries over string buffers.

Which bytes part words is up to the caller; all of them are ASCII, so cutting UTF-8
bytes gives the same words as cutting characters. Texts are read in slices of bounded
size; a longer text is read in several, each ending before one of the parting bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from trafficlens.llm.words import buffers

_BLOCK = 4096


@dataclass(frozen=True)
class Alphabet:
    """spaces part words; breaks part words and end a piece; lower folds A-Z."""

    spaces: bytes
    breaks: bytes = b""
    lower: bool = False

    def kinds(self) -> np.ndarray:
        """0 inside words, 1 a space, 2 a break, for each byte."""
        kinds = np.zeros(256, np.uint8)
        kinds[list(self.spaces)] = 1
        kinds[list(self.breaks)] = 2
        return kinds

    def fold(self) -> np.ndarray:
        table = np.arange(256, dtype=np.uint8)
        if self.lower:
            table[65:91] += 32
        return table


@dataclass
class Slice:
    """Words of the texts ``first``, ``first + 1``, ... or of a part of one of them.

    Word i is ``words[ids[i]]``, in text ``texts[i]`` (counted from ``first``), in the
    piece ``pieces[i]``; numbers of pieces are only to be compared. Words from ``own``
    on belong to the next slice of the same text and are there for n-grams across.
    """

    first: int
    n_texts: int
    ids: np.ndarray
    texts: np.ndarray
    pieces: np.ndarray
    words: pa.Array
    own: int


def _spans(offsets: np.ndarray, kinds: np.ndarray, data: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, one after the last, begin, end) of each slice."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        begin, end = int(offsets[lo]), int(offsets[hi])
        while end - begin > size:
            cut = _parting(kinds, data, begin + size, end)
            yield lo, hi, begin, cut
            begin = cut
        yield lo, hi, begin, end
        lo = hi


def _parting(kinds: np.ndarray, data: np.ndarray, at: int, end: int) -> int:
    """The place of the first byte from ``at`` on that is in no word."""
    while at < end:
        found = np.flatnonzero(kinds[data[at : at + _BLOCK]])
        if len(found):
            return min(at + int(found[0]), end)
        at += _BLOCK
    return end


def _ahead(kinds: np.ndarray, data: np.ndarray, at: int, end: int, count: int) -> int:
    """The end of the ``count`` words that follow, at most up to the next break."""
    while count and at < end:
        if kinds[data[at]] == 2:
            return at
        if kinds[data[at]] == 1:
            at += 1
        else:
            at, count = _parting(kinds, data, at, end), count - 1
    return at


def dictionary_slices(texts: pa.Array, alphabet: Alphabet, size: int, ahead: int = 0) -> Iterator[Slice]:
    """The words of a column of texts; nulls are empty. Slices have about ``size`` bytes.

    A slice that ends inside a text also holds the next ``ahead`` words of its piece.
    """
    offsets, data = buffers(texts)
    kinds, fold = alphabet.kinds(), alphabet.fold()
    for lo, hi, begin, stop in _spans(offsets, kinds, data, size):
        end = _ahead(kinds, data, stop, int(offsets[hi]), ahead)
        part = data[begin:end]
        kind = kinds[part]
        inside = kind == 0
        cuts = offsets[lo : hi + 1]
        cuts = cuts[(cuts > begin) & (cuts < end)] - begin
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        starts[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        text = np.searchsorted(offsets[lo : hi + 1], starts + begin, side="right") - 1
        marks = kind == 2
        marks[cuts] = True
        pieces = np.searchsorted(np.flatnonzero(marks), starts, side="right")
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        packed = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(fold[part[inside]])]
        )
        coded = packed.dictionary_encode()
        del part, kind, inside, marks, packed
        ids = coded.indices.to_numpy(zero_copy_only=False)
        yield Slice(lo, hi - lo, ids, text, pieces, coded.dictionary, int(np.searchsorted(starts, stop - begin)))
