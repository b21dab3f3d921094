"""Repetition inside documents, by suffix arrays over words.

The suffixes of a text are sorted by prefix doubling; only suffixes that still tie
are sorted again. Neighbours in that order share their longest common prefix, and
every maximal repeated run of words is an interval of such prefixes. The verdict
limits the share of words that long repeats cover and the longest repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.frames import map_batches, with_fields
from trafficlens.llm.words import Words, words

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "n_covered_words": pa.int64(),
    "longest_repeat": pa.int64(),
}
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
# bytes that begin a character
_IS_LEAD = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class RepeatLimits:
    """Repeats of ``run_words`` or more count as covered; the rest are limits in words and percent."""

    run_words: int = 10
    covered_percent: int = 20
    longest_percent: int = 15
    longest_words: int = 30
    base_percent: int = 20
    base_words: int = 10


def repetition(docs: DataFrame, limits: RepeatLimits = RepeatLimits()) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) with counts, base_failed and kept.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    equal to an earlier line), n_repeat_words (words in windows of five words that occur
    twice or more), n_covered_words (words in repeats of run_words or more) and
    longest_repeat (words). A text fails the base rule with fewer than base_words words or
    more than base_percent repeated words; it is kept if it passes, at most covered_percent
    of its words are covered, and its longest repeat has at most longest_words words or
    longest_percent of them. A null text has no words and fails. Rows are judged one by
    one; columns of the input with these names are replaced.
    """
    kept = [c for c in docs.columns if c not in {*_FIELDS, "base_failed", "kept"}]
    schema = with_fields(docs.select(*kept), **dict.fromkeys(_FIELDS, "long"))
    counted = map_batches(docs.select(*kept), _counter(limits.run_words), schema)
    base = (F.col("n_words") < limits.base_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * limits.base_percent
    )
    covered = F.col("n_covered_words") * 100 <= F.col("n_words") * limits.covered_percent
    longest = (F.col("longest_repeat") <= limits.longest_words) | (
        F.col("longest_repeat") * 100 <= F.col("n_words") * limits.longest_percent
    )
    return counted.withColumn("base_failed", base).withColumn("kept", ~base & covered & longest)


def _counter(run_words: int):
    def count(batches):
        for batch in batches:
            parts = [_counts(part, run_words) for part in words(batch.column("text"))]
            columns = [np.concatenate(x) if parts else np.zeros(0) for x in zip(*parts, strict=True)]
            arrays = [pa.array(c.astype(np.int64)) for c in columns] or [pa.array([], pa.int64())] * len(_FIELDS)
            yield pa.record_batch([*batch.columns, *arrays], names=[*batch.schema.names, *_FIELDS])

    return count


def _counts(part: Words, run_words: int) -> list[np.ndarray]:
    """One array for each field, with an entry for each text of the slice."""
    n = np.diff(part.offsets)
    text = np.repeat(np.arange(len(n)), n)
    chars = _characters(part, text, len(n))
    length = repeat_lengths(part.hashes, text)
    covered = lambda least: _per_text(_cover(length, least), text, len(n))
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, text, length)
    symbols, dup_lines = _symbols_and_lines(part, len(n))
    return [n, chars, symbols, dup_lines, covered(WINDOW), covered(run_words), longest]


def _per_text(marked: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text[marked], minlength=n)


def _characters(part: Words, text: np.ndarray, n: int) -> np.ndarray:
    if not len(text):
        return np.zeros(n, np.int64)
    lo, hi = int(part.starts[0]), int(part.ends[-1])
    leads = np.concatenate([[0], np.cumsum(_IS_LEAD[part.data[lo:hi]])])
    return np.bincount(text, leads[part.ends - lo] - leads[part.starts - lo], n).astype(np.int64)


def _symbols_and_lines(part: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each text, and lines with a word that equal an earlier line of it."""
    symbols, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        a, b = int(part.offsets[i]), int(part.offsets[i + 1])
        if a == b:
            continue
        # symbols are no white space, so all of them lie inside words
        raw = part.data[part.starts[a] : part.ends[b - 1]]
        symbols[i] = np.count_nonzero(_IS_SYMBOL[raw])
        whole = part.data[part.base[i] : part.stops[i]].tobytes()
        lines = [x for x in whole.split(b"\n") if x.strip(b" \t\v\f\r")]
        repeated[i] = len(lines) - len(set(lines))
    return symbols, repeated


def repeat_lengths(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word the longest run that starts there and occurs again in the same text.

    Ranks of runs of 1, 2, 4, ... words are refined as long as two runs agree; the
    common prefix of neighbours in the suffix array is read off those ranks.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    order, levels = _suffix_order(hashes, text)
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < n) & (y < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        common[same] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    return longest


def _suffix_order(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for each k the rank of the run of 2^k words at each place.

    Runs that are unique in their text, or that would leave it, keep ranks that no
    other run has.
    """
    n = len(hashes)
    _, word = np.unique(hashes, return_inverse=True)
    order = np.argsort(text.astype(np.int64) * (int(word.max()) + 1) + word, kind="stable")
    key = text.astype(np.int64) * (int(word.max()) + 1) + word
    rank = np.empty(n, np.int64)
    rank[order] = _first_of_equal(key[order])
    levels, size = [rank], 1
    while True:
        tied = _tied(rank[order])
        places = np.flatnonzero(tied)
        if not len(places):
            return order, levels
        suffixes = order[places]
        after = suffixes + size
        inside = after < n
        inside[inside] = text[after[inside]] == text[suffixes[inside]]
        # a run that leaves its text sorts before all others; its place tells it apart
        second = np.where(inside, rank[np.minimum(after, n - 1)] + n, suffixes)
        first = rank[suffixes]
        by = np.lexsort((second, first))
        order[places] = suffixes[by]
        first, second = first[by], second[by]
        new = np.ones(len(by), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[order[places]] = places[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        levels.append(rank)
        size *= 2


def _first_of_equal(values: np.ndarray) -> np.ndarray:
    """For sorted values: where the run of equal values begins."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def _tied(ranks: np.ndarray) -> np.ndarray:
    same = ranks[1:] == ranks[:-1]
    tied = np.zeros(len(ranks), bool)
    tied[1:] |= same
    tied[:-1] |= same
    return tied


def _cover(length: np.ndarray, least: int) -> np.ndarray:
    """Words inside a run of at least ``least`` words that starts at or before them."""
    starts = np.flatnonzero(length >= least)
    edge = np.zeros(len(length) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length[starts], -1)
    return np.cumsum(edge[:-1]) > 0
