"""The stages one after another, and that the library works without this part."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from brute import SF

from trafficlens.llm.kneser_ney import judged
from trafficlens.llm.mixing import mixed
from trafficlens.llm.near_dedup import near_duplicates

ROOT = Path(__file__).resolve().parent.parent.parent


def test_stages(spark, sf_docs, tmp_path):
    docs, columns = sf_docs, sf_docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            assert docs.count() == judged(before, labels).filter("kept").count() > 0
        if name == "near_dedup":
            assert near_duplicates(docs).filter("NOT kept").count() == 0
        if name == "mix":
            assert docs.count() == mixed(before).selectExpr("sum(copies)").first()[0]
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    for given in (odd_docs, no_docs):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{len(given.columns)}-{name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (given is odd_docs)


def test_entry_works_without_this_part(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
