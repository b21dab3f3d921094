"""Manifests against SQL and a plain tree, also over blocks and levels beyond one block."""

from hashlib import sha256

import pytest
from brute import SF
from comparing import database, differences
from pyspark.sql import functions as F

from trafficlens.llm import merkle
from trafficlens.llm.merkle import Manifest, folded, manifest
from trafficlens.llm.queries import ORACLES, QUERIES


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, fields):
    parts = []
    for f in fields:
        value = row[f]
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return H(*parts)


def climb(nodes):
    """(root, siblings of each node)"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            if place ^ 1 < len(nodes):
                paths[i].append(nodes[place ^ 1])
            at[i] = place >> 1
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return (nodes[0] if nodes else None), paths


def plain(rows, how):
    """Sorted (key, leaf, subroot, root, hash of the proof)"""
    groups = {}
    for row in rows:
        groups.setdefault(row[how.group], []).append((row[how.key] is not None, row[how.key] or 0, leaf(row, how.fields)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: climb([x for *_, x in sorted(groups[g])]) for g in order}
    root, above = climb([below[g][0] for g in order])
    out = []
    for g, tops in zip(order, above, strict=True):
        subroot, paths = below[g]
        for (known, key, digest), path in zip(sorted(groups[g]), paths, strict=True):
            out.append((known, key, digest, subroot, root, H(*path, *tops)))
    return sorted(out)


def check(docs, how=Manifest()):
    rows = folded(manifest(docs, how), ["leaf"]).collect()
    got = sorted(
        (r[how.key] is not None, r[how.key] or 0, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof_sha256) for r in rows
    )
    assert got == plain(docs.collect(), how)
    assert all(r.leaf_root == r.root.hex() for r in rows)


def test_same_as_sql(spark):
    result = QUERIES["op13_merkle_proofs"](spark, SF)
    assert not differences(result, database(SF), ORACLES["op13_merkle_proofs"])


def test_query_finds_what_was_altered(spark):
    rows = QUERIES["op13_merkle_proofs"](spark, SF).collect()
    import zlib

    assert {r.doc_id for r in rows if not r.verified} == {
        r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 0
    }


def test_odd_rows(odd_docs):
    check(odd_docs)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_trees_higher_than_a_block(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    docs = spark.range(150).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("g"), F.when(F.col("id") < 70, 0).when(F.col("id") < 71, 1).otherwise(F.col("id") % 9)).alias("lang"),
    )
    # blocks are made in workers, so the constant has to travel with the function
    check(docs, Manifest(fields=("doc_id", "lang")))


def test_every_row_a_group(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("lang"))
    check(docs, Manifest(fields=("doc_id",)))


def test_one_row(spark):
    check(spark.createDataFrame([(7, None)], "doc_id long, lang string"), Manifest(fields=("doc_id", "lang")))


def test_equal_rows_and_clashing_columns(spark):
    names = "tree node size digest sibling root level segment subroot at task key claim0".split()
    docs = spark.createDataFrame([(i // 4, "x", *([0] * len(names))) for i in range(13)],
                                 "doc_id long, lang string, " + ", ".join(f"{n} int" for n in names))
    check(docs, Manifest(fields=("doc_id", "lang")))


def test_greatest_number_can_be_altered(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t", "en", "s", 2**63 - 1) for i in range(20)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op13_merkle_proofs"](spark, str(tmp_path)).collect()
    assert {r.verified for r in rows} == {True, False}


def test_empty(no_docs):
    assert folded(manifest(no_docs), ["leaf"]).collect() == []
