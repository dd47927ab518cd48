"""Re-screen active subjects hit by a list change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewatch.functions.names import name_keys


def active_subjects(subjects: DataFrame) -> DataFrame:
    """Not shredded and relationship not ended."""
    return subjects.filter(F.col("shredded_at").isNull() & F.col("relationship_ended_at").isNull())


def subject_key_table(subjects: DataFrame, phonetic: bool = True) -> DataFrame:
    """(subject_id, key_hash): hashed blocking keys, written once so monitoring never decrypts subjects."""
    keys = F.array_distinct(F.flatten(F.transform("names", lambda n: name_keys(n, phonetic))))
    return subjects.select("subject_id", F.explode(keys).alias("_k")).select("subject_id", F.xxhash64("_k").alias("key_hash"))


def changed_records(delta: DataFrame, new_records: DataFrame, key: str = "source_entry_id") -> DataFrame:
    """The added and changed records of the new snapshot; removals trigger nothing."""
    hit = delta.filter(F.col("change").isin("added", "changed")).select(key)
    return new_records.join(hit, key, "left_semi")


def prior_runs(runs: DataFrame) -> DataFrame:
    """Newest run per subject by (created_at, run_id)."""
    return runs.groupBy("subject_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("prior_run_id"))


def rescreen(changed: DataFrame, subjects: DataFrame, subject_keys: DataFrame, runs: DataFrame,
             snapshot_id: str, as_of, phonetic: bool = True) -> DataFrame:
    """New monitoring runs for active subjects sharing a key with a changed record.

    The delta's key set is distinct and small next to the subject-key table; AQE
    broadcasts it from its measured size.
    """
    keys = F.array_distinct(F.flatten(F.transform("names", lambda n: name_keys(n, phonetic))))
    delta_keys = changed.select(F.explode(keys).alias("_k")).select(F.xxhash64("_k").alias("key_hash")).distinct()
    hit = subject_keys.join(delta_keys, "key_hash", "left_semi").select("subject_id").distinct()
    return (
        active_subjects(subjects).join(hit, "subject_id", "left_semi")
        .join(prior_runs(runs), "subject_id", "left")
        .select(
            F.sha2(F.concat_ws("|", F.lit("monitoring"), F.col("subject_id").cast("string"), F.lit(snapshot_id)), 256).alias("run_id"),
            "subject_id", F.lit("monitoring").alias("trigger"), F.lit(snapshot_id).alias("snapshot_id"),
            "prior_run_id", F.lit(as_of).cast("timestamp").alias("created_at"),
        )
    )


def monitoring_reason(runs: DataFrame, candidates: DataFrame, delta: DataFrame, decisions: DataFrame,
                      key: str = "source_entry_id") -> DataFrame:
    """Why each monitoring run exists, one row per changed entry that it hit (NULL when none did)."""
    changed = delta.filter(F.col("change").isin("added", "changed")).select(key)
    hits = candidates.join(changed, key, "left_semi").select("run_id", F.col(key).alias("changed_entry_id")).distinct()
    prior = decisions.select(F.col("run_id").alias("prior_run_id"), F.col("disposition").alias("prior_disposition"))
    return (
        runs.filter(F.col("trigger") == "monitoring")
        .join(hits, "run_id", "left").join(prior, "prior_run_id", "left")
        .select("run_id", "snapshot_id", "changed_entry_id", "prior_run_id", "prior_disposition")
    )
