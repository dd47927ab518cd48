"""The corpus pipeline: documents -> toxicity filter -> near-dedup -> repeated passages -> mixing -> token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewatch.llm import bpe, mixing, near_dedup as near_copies, suffix_dedup, toxicity
from sievewatch.llm.common import stage, table


#: A passage of fifty words has about 400 bytes; of those that repeat in sf0.01 half have fewer, and none has fewer than this.
PASSAGE_BYTES = 250


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one_per_class(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs, least=PASSAGE_BYTES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).drop("mix_copies", "mix_copy", "mix_order")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("mixing", mix),
    ("bpe", token_ids),
]
#: No stage but mixing can be put in SQL, so the whole is tested against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
