"""The clause grammar, what it learns, and its edges."""

import zlib

import pyarrow as pa
import pytest
from brute import SF

from trafficlens.llm.toxicity import (
    INSULT,
    NEGATION,
    REPORT,
    TARGET,
    THREAT,
    Grammar,
    _Reader,
    clause_factors,
    toxicity,
)

HOW = Grammar()


@pytest.mark.parametrize(
    ("symbols", "factor"),
    [
        ([], 0.0),
        ([TARGET], 0.0),
        ([INSULT], 1.0),
        ([THREAT], 1.0),
        ([TARGET, INSULT], HOW.targeted),
        ([INSULT, TARGET], HOW.targeted),
        ([NEGATION, INSULT], HOW.negated),
        ([INSULT, NEGATION], 1.0),
        ([REPORT, TARGET, INSULT], HOW.reported * HOW.targeted),
        ([REPORT, TARGET, NEGATION, THREAT], HOW.reported * HOW.targeted * HOW.negated),
    ],
)
def test_composed_transducer(symbols, factor):
    table, factors = clause_factors(HOW)
    state = 0
    for s in symbols:
        state = table[state, s]
    assert factors[state] == pytest.approx(factor)


def test_clauses_not_words():
    reader = _Reader({"oaf": 2.0, "dolt*": 3.0}, HOW)
    texts = ["", "you are fine", "an oaf. you, fine", "You oaf", "you are not an oaf", "they said: doltish", "they said you doltish oaf", "fine\noaf"]
    got = [x[:2] for x in reader.features(pa.array(texts))]
    want = [(0, 0), (0, 0), (2, 1), (2 * HOW.targeted, 1), (2 * HOW.targeted * HOW.negated, 1), (3, 1), (5 * HOW.targeted * HOW.reported, 1), (2, 1)]
    assert got == [(pytest.approx(b), m) for b, m in want]


def test_learns_from_labels(spark):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    rows = toxicity(docs.select("doc_id", "text"), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    bad, good = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.score >= 0.3 for r in bad) >= 0.9 * len(bad)
    assert sum(r.score >= 0.3 for r in good) <= 0.01 * len(good)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    rows = toxicity(odd_docs, labels).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity(odd_docs, none).collect()} == {0.5}
    assert toxicity(no_docs, labels).collect() == []
