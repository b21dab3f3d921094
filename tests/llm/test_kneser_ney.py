"""The model against a plain one, its sums, and whom it keeps."""

from collections import Counter

import numpy as np
import pytest
from brute import SF
from pyspark.sql import functions as F

from trafficlens.llm import kneser_ney
from trafficlens.llm.kneser_ney import (
    _SHARD,
    EDGE,
    _chunks,
    _runs_of_shards,
    judged,
    keep_fluent,
    open_log_probabilities,
)

def plain_probability(texts, characters, symbols):
    """p(run) by the definition: interpolated modified Kneser-Ney, longest order four."""
    place = {chr(c): i + 2 for i, c in enumerate(characters)}
    runs = Counter()
    for t in texts:
        x = [0, 0, 0, *(place.get(c, 1) for c in t), 0]
        runs.update(tuple(x[i : i + 4]) for i in range(len(x) - 3))
    levels = {4: runs}
    for size in (3, 2, 1):
        levels[size] = Counter(r[1:] for r in levels[size + 1])

    def discounts(counts):
        n = [0, *(sum(v == k for v in counts.values()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.0
        return [max(0.0, k - (k + 1) * y * n[k + 1] / n[k]) if n[k] else y for k in (1, 2, 3)]

    off = {size: discounts(counts) for size, counts in levels.items()}

    def p(run):
        if not run:
            return 1 / symbols
        counts = levels[len(run)]
        own = {r: n for r, n in counts.items() if r[:-1] == run[:-1]}
        total = sum(own.values())
        if not total:
            return p(run[1:])
        held = sum(off[len(run)][min(n, 3) - 1] for n in own.values())
        n = own.get(run, 0)
        kept = n - off[len(run)][min(n, 3) - 1] if n else 0
        return kept / total + held / total * p(run[1:])

    return p


def test_keeps_clean_and_rejects_junk(spark, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = judged(sf_docs, labels).join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(junk) <= 0.2 * len(junk)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 1), (7, 0), (3, None), (None, 1)], "doc_id long, quality int")
    rows = judged(odd_docs, labels).collect()
    assert len(rows) == 14
    for r in rows:
        assert (r.perplexity is None) == (not r.text)
        assert r.kept or r.text != odd_docs.first().text
    assert all(not r.kept for r in rows if not r.text)
    assert keep_fluent(odd_docs, labels).columns == odd_docs.columns
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.kept for r in judged(odd_docs, none).collect() if r.text} == {True}
    assert judged(no_docs, labels).collect() == []


def test_open_probabilities(spark):
    texts = ["abab яя cab", "bca яbba", "語語a", "cc яbab", "dad abc"]
    seen = sorted({ord(c) for t in texts for c in t})
    asked = [*texts, "zя語 ab", "zz"]
    rows = [(i % 2, i, t) for i, t in enumerate(asked)]
    labels = spark.createDataFrame([(i, 1) for i in range(len(texts))] + [(len(texts), 0)], "doc_id long, quality int")
    wanted = _runs_of_shards(spark.createDataFrame(rows, f"{_SHARD} long, doc_id long, text string"), labels)
    counts = wanted.filter("n > 0").groupBy("context", "last").agg(F.sum("n").alias("n"))
    got = {(r.context, r.last): r.log_p for r in open_log_probabilities(wanted.drop("n"), counts).collect()}
    # edge and unseen are symbols 0 and 1 of the plain model
    p = plain_probability(texts, seen, len(seen) + 2)
    place = {EDGE: 0, **{c: i + 2 for i, c in enumerate(seen)}}
    assert len(got) > 30
    for (context, last), log_p in got.items():
        run = tuple(place.get(c, 1) for c in (context >> 42, context >> 21 & 0x1FFFFF, context & 0x1FFFFF, last))
        assert np.exp(log_p) == pytest.approx(p(run), rel=1e-9)


def test_scores_other_scripts(spark):
    """Shuffled Cyrillic letters beside mostly Latin text are told from fluent ones."""
    rng = np.random.default_rng(5)
    symbols = [chr(c) for c in range(33, 127)]
    latin = [" ".join("".join(rng.choice(symbols, 6)) for _ in range(150)) for _ in range(250)]
    lexicon = "дом река лес поле город человек время слово работа дорога вода книга".split()
    fluent = [" ".join(rng.choice(lexicon, 80)) for _ in range(30)]
    letters = sorted(set("".join(lexicon)))
    junk = [" ".join("".join(rng.choice(letters, len(w))) for w in t.split()) for t in fluent[:10]]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([*((t, "en") for t in latin), *((t, "ru") for t in fluent), *((t, "ru") for t in junk)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(275)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in judged(docs, labels).collect()}
    assert all(kept[i] for i in range(280))
    assert not any(kept[i] for i in range(280, 290))


def plain_perplexities(rows, trusted):
    """{doc_id: (perplexity before drawing, characters)} by the plain model."""
    texts = [t for d, t in rows if d in trusted and t]
    seen = sorted({ord(c) for t in texts for c in t})
    place = {chr(c): i + 2 for i, c in enumerate(seen)}
    p, out = plain_probability(texts, seen, len(seen) + 2), {}
    for d, t in rows:
        x = [0, 0, 0, *(place.get(c, 1) for c in t or ""), 0]
        nats = -sum(np.log(max(5e-324, p(tuple(x[i : i + 4])))) for i in range(len(x) - 3)) if t else 0.0
        out[d] = (nats, len(t or ""))
    return out


def test_judged_as_a_whole(spark):
    """Perplexity, threshold and verdict of every row against the plain model and quantiles."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["ab", "ba", "abc", "яб"], 8))) for i in range(24)] + [(24, "zzqq zq"), (25, None)]
    trusted = set(range(18))
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d in trusted] + [(20, 0)], "doc_id long, quality int")
    plain = plain_perplexities(rows, trusted)
    rates = sorted(plain[d][0] / plain[d][1] for d in trusted)
    middle, far = rates[8], rates[17]
    most = middle + 3.5 * (far - middle)
    for r in judged(docs, labels).collect():
        nats, chars = plain[r.doc_id]
        drawn = (nats + 100 * middle) / (chars + 100)
        assert r.threshold == pytest.approx(np.exp(most), rel=1e-9)
        assert r.perplexity == (pytest.approx(np.exp(drawn), rel=1e-9) if chars else None)
        assert r.kept == (chars > 0 and drawn <= most + 1e-9)


def test_chunks_of_long_texts_are_seamless(monkeypatch):
    texts = ["abcdefghij" * 7, "", None, "xy", "q" * 30]
    whole = [np.concatenate(x) for x in zip(*_chunks(texts), strict=True)]
    monkeypatch.setattr(kneser_ney, "CHUNK_CHARS", 8)
    cut = [np.concatenate(x) for x in zip(*_chunks(texts), strict=True)]
    assert len(whole[0]) == sum(len(t) + 1 for t in texts if t)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_clashing_columns_come_back(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    names = "middle most nats chars perplexity threshold".split()
    docs = odd_docs.selectExpr("*", *(f"size AS {n}" for n in names))
    out = keep_fluent(docs, labels)
    assert out.columns == docs.columns
    assert all({r[n] for n in names} == {r["size"]} for r in out.collect())
    assert {"middle", "most", "nats", "chars"} <= set(judged(docs, labels).columns)
