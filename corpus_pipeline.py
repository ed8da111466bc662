"""A corpus pipeline: language, toxicity, near duplicates, mixing, tokens.

Each stage takes the documents that the stage before kept, as a table, and decides about all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqspark.llm import bpe, lang_id, mixing, near_dup, toxicity
from seqspark.llm.common import scratch, written
from seqspark.llm.queries import domain_labels


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter or text, and those farther from every learnt language than labelled rows of their size are."""
    return lang_id.filter_languages(docs, lang_id.fit_languages(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.3 or more."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filter_toxic(docs, model, 0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: of those with the smallest id, or all where none has an id, that with the least text hash. Texts without words stay."""
    return near_dup.survivors(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the expected tokens of each domain meet their targets."""
    mixer = mixing.fit_mixture(docs, domain_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixing.mixed(docs, mixer)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids' count and digests."""
    import public_tokenizers

    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe_tokens", token_stage),
]

#: Stages learn models and compare texts by similarity, which SQL can't express; tests hold the operators of the stages against plain versions, run() itself only for its columns.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{base}/{k}-{name}")
    return docs
