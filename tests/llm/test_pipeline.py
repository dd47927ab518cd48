"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sievewatch.llm import mixing, toxicity
from sievewatch.llm.queries import ORACLE, QUERIES
from tests.llm.test_near_dedup import plain_kept
from tests.llm.test_suffix_dedup import plain


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, step in corpus_pipeline.STAGES:
        docs.append(step(spark, docs[-1], sf_dir).cache())
    return docs


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "suffix-array dedup", "mixing", "bpe"]


def test_stages(spark, sf_dir, staged):
    docs, clean, single, cut, mixed, ids = staged
    assert all(d.columns == docs.columns for d in (clean, single, cut, mixed))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r.id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    assert sorted(r.doc_id for r in single.collect()) == plain_kept([(r.doc_id, r.text) for r in clean.collect()])
    removed = {i: n for i, _, n, _, _ in plain([(r.doc_id, r.text) for r in single.collect()], corpus_pipeline.PASSAGE_BYTES)}
    before = {r.doc_id: len(r.text.encode()) for r in single.collect()}
    for r in cut.collect():
        assert 0 <= before[r.doc_id] - removed[r.doc_id] - len(r.text.encode()) <= 6  # parts of cut characters go too
    want = {r.doc_id: r.n for r in mixing.poisson_copies(cut, mixing.source_rates(cut)).select("row.doc_id", F.col("mix_copies").alias("n")).collect()}
    got = dict(mixed.groupBy("doc_id").count().collect())
    assert got == {i: n for i, n in want.items() if n}
    assert ids.count() == mixed.count()
    assert ids.select("doc_id", "n_tokens").distinct().count() == len(got)


def test_stages_take_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf_dir)
        assert docs.count() == 0
