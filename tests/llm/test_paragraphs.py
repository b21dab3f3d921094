"""Removing repeated passages, near-equal paragraphs, and leaving the rest alone."""

import random
from collections import Counter

import numpy as np
import pytest
from brute import SF  # noqa: F401

from trafficlens.llm.paragraphs import PassageRules, _anchors, keep_first, without_repeats

RNG = random.Random(5)


def prose(n, seed):
    """n words in sentences of eight."""
    own = random.Random(seed)
    out = []
    for i in range(n):
        word = "".join(own.choice("abcdefghijklmno") for _ in range(own.randint(2, 9)))
        out.append((word.capitalize() if i % 8 == 0 else word) + ("." if i % 8 == 7 else ""))
    return " ".join(out)


def cut(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r.text, r.removed_words) for r in without_repeats(frame).collect()}


def test_passages_and_paragraphs(spark):
    passage, a, b, c = prose(64, 1), prose(100, 2), prose(101, 3), prose(99, 4)
    half = lambda t, n: (" ".join(t.split()[:n]), " ".join(t.split()[n:]))
    b1, b2 = half(b, 50)
    c1, c2 = half(c, 33)
    paragraph = prose(80, 6)
    edited = " ".join(["other", *paragraph.split()[1:-1], "end."])
    docs = [
        (1, f"{a}\n{passage}"),
        (2, f"{b1} {passage} {b2}"),
        (3, f"{c1} {passage} {c2}\n{paragraph}"),
        (4, f"{prose(60, 7)}\n{edited}\n{prose(30, 8)}"),
        (5, f"{prose(60, 9)}\n{prose(12, 10)}\n{prose(60, 11)}"),
        (6, f"{prose(60, 12)}\n{prose(12, 10)}\n{prose(60, 13)}"),
        (7, f"{prose(60, 14)}\n{prose(40, 15)}\n{prose(40, 15)}"),
    ]
    got = cut(spark, docs)
    assert got[1] == (docs[0][1], 0)
    for k, before, behind in ((2, b1, b2), (3, c1, f"{c2}\n{paragraph}")):
        text, removed = got[k]
        assert 64 - 14 <= removed <= 64 and text.startswith(before) and text.endswith(behind)
        # what is left of the passage are its ends
        rest = text[len(before) : len(text) - len(behind)].split()
        words = passage.split()
        assert any(rest == words[:n] + words[len(words) - len(rest) + n :] for n in range(len(rest) + 1))
    assert got[4] == (f"{prose(60, 7)}\n{prose(30, 8)}", 80)
    # a short common line and a paragraph that only its own document repeats stay
    assert all(got[k] == (docs[k - 1][1], 0) for k in (5, 6, 7))


LAYOUTS = {
    "wrapped": lambda words, at: "".join(w + ("\n" if (i + at) % 11 == 10 else " ") for i, w in enumerate(words)),
    "sentences": lambda words, at: " ".join(w + ("." if (i + at) % 9 == 8 else "") for i, w in enumerate(words)),
    "one line": lambda words, at: " ".join(words),
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("size", [51, 60])
def test_planted_passages(spark, layout, size):
    """Pairs of documents that share one passage, each document laid out by itself around it."""
    own, docs, passages = random.Random(size), [], {}
    word = lambda: "".join(own.choice("abcdefghijklmno") for _ in range(own.randint(2, 9)))
    for pair in range(100):
        passage = [word() for _ in range(size)]
        if layout == "sentences":
            passage = [w + ("." if i % 9 == 4 else "") for i, w in enumerate(passage)]
        for side in range(2):
            before, behind = ([word() for _ in range(own.randint(20, 120))] for _ in range(2))
            # line ends inside the passage depend on what stands before it
            middle = passage if layout == "sentences" else LAYOUTS[layout](passage, len(before)).split(" ")
            text = f"{LAYOUTS[layout](before, 0)} {' '.join(middle)} {LAYOUTS[layout](behind, 0)}"
            docs.append((2 * pair + side, text))
            passages[2 * pair + side] = " ".join(passage).split()
    docs += [(1000 + i, LAYOUTS[layout]([word() for _ in range(150)], i)) for i in range(100)]
    got = cut(spark, docs)
    texts = dict(docs)
    removed = [got[d][1] for d in range(1, 200, 2)]
    assert all(got[d] == (texts[d], 0) for d in [*range(0, 200, 2), *range(1000, 1100)])
    assert sum(n >= size - 14 for n in removed) >= 95 and sum(removed) >= 0.8 * size * 100
    for d in range(1, 200, 2):
        gone, left = Counter(texts[d].split()), Counter(got[d][0].split())
        assert not (gone - left) - Counter(passages[d]) and not left - gone


def test_anchors_are_shared_by_shared_runs():
    """Whatever stands around it, a run of window + anchor_words - 1 words has an anchor inside."""
    rng = np.random.default_rng(1)
    rules = PassageRules()
    need = rules.window + rules.anchor_words - 1
    run = rng.integers(0, 1 << 63, need, dtype=np.uint64)
    for _ in range(50):
        found = []
        for _ in range(2):
            before, behind = (rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64) for _ in range(2))
            at = _anchors(np.concatenate([before, run, behind]), rules) - len(before)
            found.append({int(x) for x in at if 0 <= x <= need - rules.anchor_words})
        assert found[0] & found[1]


def test_sf_table(sf_docs):
    """No run of fifty words stands in two documents any more, but for a few edges."""
    rows = without_repeats(sf_docs).collect()

    def covered(texts):
        seen, total = {}, 0
        for d, words in texts:
            for i in range(len(words) - 49):
                seen.setdefault(hash(tuple(words[i : i + 50])), set()).add(d)
        for _, words in texts:
            mask = [False] * len(words)
            for i in range(len(words) - 49):
                if len(seen[hash(tuple(words[i : i + 50]))]) > 1:
                    mask[i : i + 50] = [True] * 50
            total += sum(mask)
        return total

    before = covered([(r.doc_id, r.text.lower().split()) for r in sf_docs.collect()])
    after = covered([(r.doc_id, r.text.lower().split()) for r in rows])
    assert after <= 0.02 * before


def test_odd_rows(odd_docs, no_docs):
    rows = without_repeats(odd_docs).collect()
    assert len(rows) == 14
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    base = odd_docs.first().text
    assert by_id[1][0].text == base and [r.text for r in by_id[2]] == ["", ""]
    assert by_id[4][0].text is None and by_id[5][0].text == "" and by_id[6][0].text == " \n\t "
    assert sorted((r.text for r in by_id[None]), key=str) == sorted([None, base], key=str)
    assert by_id[7][0].removed_words == 0 and by_id[8][0].removed_words >= 79_000
    kept = keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 9, 10, 11]
    assert without_repeats(no_docs).collect() == []
