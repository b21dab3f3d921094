"""Packing: token ids by a whole-text tokenizer, gapless sequences, bounds."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trafficlens.llm.packing import Packing, best_fit_decreasing, fewest_bins, packed
from trafficlens.llm.queries import word_tokenizer

HOW = Packing(word_tokenizer())


def check(docs, how):
    """Every document's ids come back, and no sequence is too long or has gaps."""
    tokenizer = Tokenizer.from_file(how.tokenizer)
    tokenizer.encode_special_tokens = True
    rows = packed(docs, how).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, how.end]
        for k, at in enumerate(range(0, len(ids), how.tokens)):
            part = np.array(ids[at : at + how.tokens], "<u4")
            want.append((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1])
        assert own[-1][0] + own[-1][1] <= how.tokens
    return len(sequences), np.array([r.length for r in rows])


def test_whole_table_is_packed_to_the_bound(sf_docs):
    used, lengths = check(sf_docs, HOW)
    assert used <= fewest_bins(lengths, HOW.tokens) + 1


def test_exchange_between_buckets(sf_docs):
    used, lengths = check(sf_docs, Packing(HOW.tokenizer, bucket_pieces=40))
    assert used <= 1.02 * fewest_bins(lengths, HOW.tokens)


def test_odd_rows(odd_docs):
    check(odd_docs, HOW)


def test_hard_texts(spark):
    texts = ["It's 'tis dogs' life!!", "ΣΊΣΥΦΟΣ straße İ “quoted”, (x) 1st. a1.", "é́. \x1c a\x1db c　d",
             "<|endoftext|> x<|endoftext|>.", "...", "a" * 5000]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), HOW)


def test_empty(no_docs):
    assert packed(no_docs, HOW).collect() == []


def fewest(lengths, capacity):
    """By trying everything."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_is_a_bound(lengths):
    capacity, x = 20, np.array(lengths)
    least, used = fewest_bins(x, capacity), int(best_fit_decreasing(x, capacity).max()) + 1
    assert least <= fewest(sorted(lengths, reverse=True), capacity) <= used
