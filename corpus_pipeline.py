"""A training-text pipeline over ``documents``: quality, copies, passages, mix, packing.

Nulls, empty texts, ties, repeated rows and extra columns follow the operators that the
stages call: a document without text has no perplexity and is rejected by the first
stage, a row without doc_id is never a copy, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trafficlens.llm.kneser_ney import keep_fluent
from trafficlens.llm.mixing import apply_mix
from trafficlens.llm.near_dedup import keep_one
from trafficlens.llm.packing import Packing, packed
from trafficlens.llm.paragraphs import keep_first
from trafficlens.llm.queries import table, word_tokenizer
from trafficlens.sources.workspace import scratch_path


def fluent(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted text is not too high."""
    return keep_fluent(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has."""
    return keep_first(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the mix; a document that is taken twice is there twice."""
    return apply_mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packed(docs, Packing(word_tokenizer()))


STAGES = [
    ("quality", fluent),
    ("near_dedup", one_of_each),
    ("passages", passages_once),
    ("mix", to_weights),
    ("packing", sequences),
]

# perplexities and tokens can't be expressed in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
