"""The mix against its SQL, and its edges."""

import pytest
from brute import SF
from comparing import database, differences

from trafficlens.llm.mixing import Mix, apply_mix, mixed
from trafficlens.llm.queries import ORACLES, QUERIES


def test_same_as_sql(spark):
    assert not differences(QUERIES["op9_mixing"](spark, SF), database(SF), ORACLES["op9_mixing"])


def test_odd_rows(odd_docs):
    rows = mixed(odd_docs).collect()
    assert len(rows) == 14 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    for own in sources.values():
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    total = sum(r["size"] for r in rows)
    assert sum(own[0].target for own in sources.values()) == pytest.approx(1.5 * total)


def test_stage_repeats_documents(odd_docs):
    out = apply_mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == mixed(odd_docs).selectExpr("sum(copies)").first()[0]


def test_larger_share_keeps_all_of_a_smaller(sf_docs):
    small = {r.doc_id: r.taken for r in mixed(sf_docs, Mix(share_percent=60)).collect()}
    large = {r.doc_id: r.taken for r in mixed(sf_docs, Mix(share_percent=90)).collect()}
    assert all(large[d] >= n for d, n in small.items())


def test_empty(no_docs):
    assert mixed(no_docs).collect() == []
