"""Language profiles: held-out accuracy, texts without letters, edges."""

import zlib

from trafficlens.llm.language import language_of


def test_held_out_accuracy(sf_docs):
    rows = language_of(sf_docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark, sf_docs):
    few = sf_docs.filter("doc_id < 200")
    turned = few.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'xx' ELSE lang END lang")
    before = {(r.doc_id, r.lang_pred, r.score) for r in language_of(few).collect()}
    assert before == {(r.doc_id, r.lang_pred, r.score) for r in language_of(turned).collect()}


def test_odd_rows(odd_docs, no_docs):
    rows = language_of(odd_docs).collect()
    assert len(rows) == 14
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de", "fr")
    assert language_of(no_docs).collect() == []
