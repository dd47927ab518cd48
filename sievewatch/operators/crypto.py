"""Per-subject envelope encryption with the built-in AES-GCM functions.

Every subject has a random data key, wrapped by a master key. The additional
authenticated data binds a ciphertext to its purpose and subject. Master keys
travel as a tiny one-row-per-version table, so they never appear as literals
in a plan, and shredding only rewrites the key table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

KEY_PURPOSE = "dek"


def master_keys(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    """(master_id, master_key) for the versions held as job secrets; 32 bytes each."""
    for key in keys.values():
        if len(key) != 32:
            raise ValueError("a master key has 32 bytes")
    return spark.createDataFrame([(k, bytearray(v)) for k, v in keys.items()], "master_id string, master_key binary")


def _aad(purpose: str) -> Column:
    return F.concat(F.lit(f"{purpose}:"), F.col("subject_id").cast("string"))


def new_subject_keys(subjects: DataFrame, existing: DataFrame | None, masters: DataFrame, master_id: str) -> DataFrame:
    """Wrapped keys for subjects that have none yet. Write the result once before using it."""
    ids = subjects.select("subject_id").distinct()
    if existing is not None:
        ids = ids.join(existing.select("subject_id"), "subject_id", "left_anti")
    # The operating system's generator is needed here; Spark's uuid and rand are seeded and guessable.
    # A local function travels by value, so workers need no copy of this package.
    def draw_keys(ids: pd.Series) -> pd.Series:
        import os

        return ids.map(lambda _i: os.urandom(32))

    draw = F.pandas_udf(draw_keys, BinaryType()).asNondeterministic()
    fresh = ids.withColumn("master_id", F.lit(master_id)).withColumn("_dek", draw(F.col("subject_id").cast("string")))
    return fresh.join(F.broadcast(masters), "master_id").select(
        "subject_id", "master_id",
        F.aes_encrypt("_dek", "master_key", F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), _aad(KEY_PURPOSE)).alias("wrapped_key"),
        F.lit(None).cast("timestamp").alias("destroyed_at"),
    )


def derived_subject_keys(subjects: DataFrame, masters: DataFrame, master_id: str, salt: str) -> DataFrame:
    """Wrapped keys derived from the master key and the subject, for replays of fixed data: every run unwraps the same key.

    Unlike drawn keys these can be derived again from the master key, so destroying one shreds nothing for its holder.
    """
    ids = subjects.select("subject_id").distinct().withColumn("master_id", F.lit(master_id)).join(F.broadcast(masters), "master_id")
    dek = F.unhex(F.sha2(F.concat("master_key", F.lit(salt).cast("binary"), F.col("subject_id").cast("string").cast("binary")), 256))
    return ids.select(
        "subject_id", "master_id",
        F.aes_encrypt(dek, "master_key", F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), _aad(KEY_PURPOSE)).alias("wrapped_key"),
        F.lit(None).cast("timestamp").alias("destroyed_at"),
    )


def _with_dek(df: DataFrame, keys: DataFrame, masters: DataFrame) -> DataFrame:
    held = keys.join(F.broadcast(masters), "master_id", "left").select(
        "subject_id", "wrapped_key",
        F.try_aes_decrypt("wrapped_key", "master_key", F.lit("GCM"), F.lit("DEFAULT"), _aad(KEY_PURPOSE)).alias("_dek"),
    )
    return df.join(held, "subject_id", "left")


def encrypt(df: DataFrame, keys: DataFrame, masters: DataFrame, column: str, purpose: str = "data",
            out: str | None = None) -> DataFrame:
    """Replace a string column by its ciphertext; a subject without a usable key fails the job."""
    sealed = F.aes_encrypt(F.col(column).cast("binary"), F.col("_dek"), F.lit("GCM"), F.lit("DEFAULT"),
                           F.lit("").cast("binary"), _aad(purpose))
    ready = _with_dek(df, keys, masters)
    value = F.when(F.col("_dek").isNotNull(), sealed).otherwise(
        F.raise_error(F.concat(F.lit("no usable data key for subject "), F.col("subject_id").cast("string"))))
    result = ready.withColumn(out or f"{column}_sealed", value).drop("_dek", "wrapped_key")
    return result if (out or "") == column else result.drop(column)


def decrypt(df: DataFrame, keys: DataFrame, masters: DataFrame, column: str, purpose: str = "data",
            out: str = "plain") -> DataFrame:
    """Add the plaintext and ``shredded``; a live key that does not authenticate fails the job."""
    ready = _with_dek(df, keys, masters)
    shredded = F.col("wrapped_key").isNull() | F.col(column).isNull()
    opened = F.try_aes_decrypt(F.col(column), F.col("_dek"), F.lit("GCM"), F.lit("DEFAULT"), _aad(purpose)).cast("string")
    bad = F.raise_error(F.concat(F.lit("ciphertext does not authenticate for subject "), F.col("subject_id").cast("string")))
    return (
        ready.withColumn("shredded", shredded)
        .withColumn(out, F.when(~shredded, F.coalesce(opened, bad.cast("string"))))
        .drop("_dek", "wrapped_key")
    )


def shred_due(subjects: DataFrame, as_of, days: int = 1825) -> DataFrame:
    """Subjects whose relationship ended at least ``days`` ago and that are not shredded yet."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return subjects.filter(F.col("shredded_at").isNull() & F.col("relationship_ended_at").isNotNull()
                           & (F.col("relationship_ended_at") <= cutoff))


def shred(subjects: DataFrame, keys: DataFrame, as_of, days: int = 1825) -> tuple[DataFrame, DataFrame]:
    """New versions of the subject and key tables: due keys and PII blobs become NULL.

    Decisions are not touched; their ciphertext simply stops being readable.
    """
    due = shred_due(subjects, as_of, days).select("subject_id", F.lit(True).alias("_due"))
    now = F.lit(as_of).cast("timestamp")

    def marked(df: DataFrame) -> DataFrame:
        return df.join(due, "subject_id", "left")

    gone = F.col("_due").isNotNull()
    blobs = {c: F.when(~gone, F.col(c)) for c in subjects.columns if c.startswith("pii_")}
    new_subjects = marked(subjects).withColumns(
        {**blobs, "shredded_at": F.when(gone, now).otherwise(F.col("shredded_at"))}).drop("_due")
    new_keys = marked(keys).withColumns(
        {"wrapped_key": F.when(~gone, F.col("wrapped_key")),
         "destroyed_at": F.when(gone, now).otherwise(F.col("destroyed_at"))}).drop("_due")
    return new_subjects, new_keys
