"""The registered queries of this subpackage: thin digests of each operator's output over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewatch.llm import ann, bpe, divergence, mixing, periodic, sharding, simhash, suffix_dedup, token_files, toxicity, url_graph, warc
from sievewatch.llm.common import table


def op1_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", predicted, "n_tokens", F.size("passages").alias("n_passages"))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_copies", "mix_copy", "mix_order")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_tokens(table(spark, sf_dir, "documents"), with_ids=False)


def op8_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", law, "shard", "slot", grown)


def op10_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), 20).withColumnRenamed("id", "vec_id")


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def _plant_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The stated test runs: about a tenth of the documents repeat a block of their own words to the end."""
    n = len(words)
    drawn, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest or not n or doc_id is None:
        return words
    start = drawn % n
    period = 1 + (n - start) // (3 + drawn % 8)
    return [words[i] if i < start else words[start + (i - start) % period] for i in range(n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=_plant_run)
    return periodic.run_report(found).withColumnRenamed("id", "doc_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_link_graph": op1_url_link_graph,
    "op2_toxicity": op2_toxicity,
    "op3_poisson_mixing": op3_poisson_mixing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_hnsw_near_dedup": op6_hnsw_near_dedup,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_orc_token_files": op8_orc_token_files,
    "op9_kd_tree_sharding": op9_kd_tree_sharding,
    "op10_hnsw_neighbours": op10_hnsw_neighbours,
    "op11_warc_archives": op11_warc_archives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE: dict[str, str] = {
    "op1_url_link_graph": url_graph.judge_sql(),
    "op3_poisson_mixing": mixing.MIX_SQL,
    "op11_warc_archives": warc.ARCHIVE_SQL,
    "op13_source_divergence": divergence.DIVERGENCE_SQL,
}
