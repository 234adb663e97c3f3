"""One registered query per operator, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import (
    bitsliced,
    byte_bpe,
    divergence,
    language,
    mixing,
    packing,
    personal_data,
    prefix_tree,
    prefix_trie,
    quality,
    token_files,
    toxicity,
    viterbi,
)
from holdfast.llm.common import documents, held_out, prepare, tokenizer_path
from holdfast.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and digested."""
    files = token_files.write(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2, added=True)
    return token_files.digests(spark, files)


@query
def op2_toxicity_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offsets of every document; learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    fold = held_out(F.col("doc_id"), 5, 0)
    field = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~fold)
    return toxicity.scored(docs, field).select("doc_id", fold.alias("held_out"), "score", "predicted", "spans")


@query
def op3_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows for every fiftieth vector."""
    return bitsliced.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block and slot of every document in the mix of its sources."""
    return mixing.schedule(documents(spark, sf_dir))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count and best score of every whole text."""
    return viterbi.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: fixed patterns and what the span classifier adds."""
    return personal_data.digests(*personal_data.found_in(documents(spark, sf_dir)))


@query
def op7_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    fold = held_out(F.col("doc_id"), 4, 2)
    model = language.learned(docs, learn=~fold)
    return language.predicted(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")


@query
def op8_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under 5-word shingles and Jaccard 0.75."""
    return prefix_tree.groups(documents(spark, sf_dir))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    docs = documents(spark, sf_dir)
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=False, added=True)


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and adaptive verdict of every document."""
    return quality.verdicts(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by a serialised BPE model, and the bytes decoded from them, as digests."""
    path = byte_bpe.ranks_path()
    return byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(documents(spark, sf_dir), path), path))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of every two sources of a language, and the terms each source uses more than its language."""
    return divergence.audited(documents(spark, sf_dir))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
