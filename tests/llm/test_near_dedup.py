"""MinHash bands, odd sketches and their confirmation against all pairs."""

import brute
import numpy as np

from trafficlens.llm import near_dedup
from trafficlens.llm.components import components
from trafficlens.llm.minhash import SKETCH_BITS
from trafficlens.llm.near_dedup import NearDuplicates, keep_one, near_duplicates


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_same_as_all_pairs(spark, sf_docs):
    docs = [(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    got = near_duplicates(sf_docs, NearDuplicates(shingle_words=2))
    assert found(got) == brute.near_duplicates(docs, 2)


def test_chain_of_near_copies(spark):
    """Neighbours in the chain link, its ends do not: one component all the same."""
    words = [f"w{i}" for i in range(140)]
    docs = [(100 - k, " ".join(words[k * 5 : k * 5 + 60])) for k in range(12)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), NearDuplicates(shingle_words=2))
    assert found(got) == brute.near_duplicates(docs, 2)
    assert {c for _, c in found(got).values()} == {89}


def test_large_family_is_no_square(spark, monkeypatch):
    """600 texts of one template, some words changed: nearly half of the pairs link, some members hardly."""
    from trafficlens.llm import near_dedup

    rng = np.random.default_rng(4)
    template = [f"w{i}" for i in range(150)]
    docs = []
    for d in range(600):
        own = list(template)
        for k in rng.choice(150, 1 + d % 9, replace=False):
            own[k] = f"x{rng.integers(10**6)}"
        docs.append((d, " ".join(own)))
    checked, stored = {}, near_dedup.stored

    def counting(df, name, **options):
        out = stored(df, name, **options)
        if name in ("met", "across"):
            checked[name] = checked.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "stored", counting)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), NearDuplicates(shingle_words=2))
    assert found(got) == brute.near_duplicates(docs, 2)
    # of all 179,700 pairs; those of members that hardly link at all are checked one by one
    assert checked.get("met", 0) + checked.get("across", 0) < 0.2 * 179_700, checked


def test_family_below_the_threshold_is_hardly_checked(spark, monkeypatch):
    """200 texts of one template that nearly all lie at 0.74 to each other, and two that link."""
    from trafficlens.llm import near_dedup

    rng = np.random.default_rng(6)
    template = [f"w{i}" for i in range(300)]
    docs = []
    for d in range(200):
        own = list(template)
        for k in rng.choice(300, 12, replace=False):
            own[k] = f"x{rng.integers(10**6)}"
        docs.append((d, " ".join(own)))
    docs.append((200, docs[150][1] + " and more"))
    checked, stored = [], near_dedup.stored

    def counting(df, name, **options):
        out = stored(df, name, **options)
        if name in ("met", "across"):
            checked.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stored", counting)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), NearDuplicates(shingle_words=2))
    assert found(got) == brute.near_duplicates(docs, 2)
    assert sum(checked) < 0.1 * 19_900, checked


def test_odd_rows(odd_docs):
    rows = near_duplicates(odd_docs, NearDuplicates(shingle_words=2)).collect()
    assert len(rows) == 14
    own = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert own[1] == [(59, 1, True)] and own[2] == [(59, 1, False)] * 2 and own[3] == [(59, 1, False)]
    assert own[4] == [(0, 4, True)] and own[5] == [(0, 5, True)] and own[6] == [(0, 6, True)]
    assert sorted(own[None]) == [(0, None, True), (59, None, True)]
    assert own[8][0][1:] == (7, False) and own[9] == [(1, 9, True)] and own[10] == [(1, 9, False)]


def test_stage_keeps_columns(odd_docs):
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 6, 7, 9, 11]


def test_empty(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100}


def test_sketch_tells_similar_from_unlike():
    hasher, rng = NearDuplicates().sketcher(), np.random.default_rng(1)
    limit = hasher.most_odd_bits(0.8)
    assert limit < SKETCH_BITS
    for share, passes in ((0.82, True), (0.65, False)):
        common = int(2000 * share / (1 + share))
        a, other = rng.integers(0, 1 << 63, 1000, dtype=np.uint64), rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:common], other[common:]])
        x, y = (hasher.odd_sketch(hasher.samples(s)) for s in (a, b))
        odd = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        similarity = common / (2 * len(a) - common)
        assert (odd <= limit) == passes, (similarity, odd, limit)


def test_finer_sketch_tells_more():
    hasher, rng = NearDuplicates().finer(), np.random.default_rng(1)
    limit = hasher.most_odd_bits(0.8)
    for share, passes in ((0.81, True), (0.73, False)):
        common = int(2000 * share / (1 + share))
        a, other = rng.integers(0, 1 << 63, 1000, dtype=np.uint64), rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        x, y = (hasher.sketch_of(m) for m in (a, np.concatenate([a[:common], other[common:]])))
        assert len(x) * 64 == hasher.sketch_bits
        odd = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert (odd <= limit) == passes, (share, odd, limit)


def test_finer_sketch_keeps_pairs_at_the_threshold():
    hasher, rng = NearDuplicates().finer(), np.random.default_rng(3)
    limit, over, bits = hasher.most_odd_bits(0.8), 0, hasher.sketch_bits
    for _ in range(10):
        flips = 2 * rng.binomial(hasher.n, 0.2, 1000)
        at = np.repeat(np.arange(1000), flips) * bits + rng.integers(0, bits, flips.sum())
        odd = np.bincount(at, minlength=1000 * bits).reshape(1000, bits) & 1
        over += int((odd.sum(axis=1) > limit).sum())
    assert over == 0


def test_sketch_keeps_pairs_at_the_threshold():
    """By simulation: flips of differing samples fall on random bits."""
    hasher, rng = NearDuplicates().sketcher(), np.random.default_rng(2)
    limit, over = hasher.most_odd_bits(0.8), 0
    for _ in range(20):
        flips = 2 * rng.binomial(hasher.n, 0.2, 5000)
        at = np.repeat(np.arange(5000), flips) * SKETCH_BITS + rng.integers(0, SKETCH_BITS, flips.sum())
        bits = np.bincount(at, minlength=5000 * SKETCH_BITS).reshape(5000, SKETCH_BITS)
        over += int(((bits & 1).sum(axis=1) > limit).sum())
    assert over == 0


def test_members_of_shared_buckets_take_few_of_them(spark):
    rows = [(bucket, node) for node in range(200) for bucket in range(32)] + [(100, 500), (101, 500)]
    members = spark.createDataFrame(rows, "bucket long, node long")
    turns = [{r["node"]: r["bucket"] for r in near_dedup._one_bucket(members, turn).collect()} for turn in range(4)]
    assert all(set(t) == {*range(200), 500} and t[500] in (100, 101) for t in turns)
    assert all(len({b for node, b in t.items() if node < 200}) <= near_dedup.HUB_GROUPS for t in turns)
    assert len({tuple(sorted(t.items())) for t in turns}) > 1
