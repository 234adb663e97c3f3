"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data is masked,
sources are mixed to target weights, and the rest is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and calls one operator; its rows are written as Parquet and read again as
the next stage's documents; packing takes them in the order in which mixing wrote them. All stages but the last return the columns of their documents.

Defined cases, in every stage: null texts count as empty and stay; extra columns are passed on; an empty
table gives an empty table; repeated rows are separate documents, save that near-duplicate removal keeps one row
of an id. See the operators for theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import mixing, packing, personal_data, prefix_tree, toxicity
from holdfast.llm.common import documents, prepare, settle, tokenizer_path, written_place

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    """Stages can be called on their own, so each sends the package to the executors."""

    @wraps(fn)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, docs, sf_dir)

    return call


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; learned from all labels."""
    field = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, field)


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return prefix_tree.representatives(docs)


@stage
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in the text."""
    _, weights = personal_data.found_in(docs)
    return personal_data.masked(docs, weights)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; a source weighs the square root of its size."""
    return mixing.interleaved(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; sequences follow the order of the documents."""
    placed = written_place(docs, "_place")
    return packing.packed_in_order(placed, tokenizer_path("word_bpe_49k.json"), "_place", added=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Neither the trained stages nor the packing can be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, apply in STAGES[:-1]:
        docs = settle(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
