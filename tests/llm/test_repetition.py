"""Counts of repetition against plain counting, and the verdict."""

import brute
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from trafficlens.llm.repetition import RepeatLimits, _counts, repetition
from trafficlens.llm.words import words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAb \n\t#é.", max_size=60), min_size=1, max_size=6))
def test_counts(texts):
    got = []
    for part in words(pa.array(texts)):
        n, chars, symbols, lines, repeat, _, longest = _counts(part, 10)
        got += zip(*(x.tolist() for x in (n, chars, symbols, lines, repeat, longest)), strict=True)
    assert got == [brute.repeats(t) for t in texts]


def test_verdict(spark):
    fresh = " ".join(f"w{i}" for i in range(200))
    twice = " ".join([*(f"a{i}" for i in range(40)), *(f"x{i}" for i in range(200)), *(f"a{i}" for i in range(40))])
    rows = [(1, fresh), (2, twice), (3, "too few words"), (4, None), (5, "")]
    got = {r.doc_id: r for r in repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (r.base_failed, r.kept) for k, r in got.items()} == {
        1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (True, False)
    }
    loose = RepeatLimits(base_percent=90)
    got = {r.doc_id: r for r in repetition(spark.createDataFrame(rows[:2], "doc_id long, text string"), loose).collect()}
    assert (got[2].base_failed, got[2].kept, got[2].longest_repeat) == (False, False, 40)


def test_odd_rows(odd_docs, no_docs):
    rows = repetition(odd_docs).collect()
    assert len(rows) == 14
    for r in rows:
        if len(r.text or "") < 5000:
            assert tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")) == brute.repeats(r.text)
    assert repetition(no_docs).collect() == []
