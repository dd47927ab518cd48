"""Versioned list snapshots: identity, diffs, coverage, retention, ingest guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Lists every screening must have checked, and how old they may be.
REQUIRED_SOURCES = ("ofac_sdn", "un_consolidated", "eu_fsf", "uk_ofsi")
MAX_LIST_AGE_DAYS = 7
COMPARED = ("names", "dobs", "pobs", "nationalities", "documents")


def new_snapshots(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Landed raw files whose SHA-256 differs from the latest snapshot of their source.

    ``files`` has source, content (binary), retrieved_at; only hashes are compared and kept.
    """
    latest = snapshots.groupBy("source").agg(F.max_by("content_sha256", "retrieved_at").alias("_last"))
    hashed = files.select("source", "retrieved_at", F.sha2("content", 256).alias("content_sha256"))
    return (
        hashed.join(latest, "source", "left")
        .filter(~F.col("content_sha256").eqNullSafe(F.col("_last"))).drop("_last")
        .withColumn("snapshot_id", F.sha2(F.concat_ws("|", "source", F.col("retrieved_at").cast("string"), "content_sha256"), 256))
    )


def snapshot_delta(old: DataFrame, new: DataFrame, key: str = "source_entry_id",
                   compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """(entry, change in added|changed|removed). Arrays compare in order, NULLs as equal.

    Both sides are reduced to the key and one 64-bit pair of hashes before the shuffle, so the
    full outer join moves fixed-width rows whatever the records hold.
    """
    def digest(df: DataFrame, name: str) -> DataFrame:
        body = F.to_json(F.struct(*compared))
        return df.select(key, F.struct(F.xxhash64(body).alias("h1"), F.sha2(body, 256).alias("h2")).alias(name))

    joined = digest(old, "_old").join(digest(new, "_new"), key, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed")
    )
    return joined.select(key, change.alias("change")).filter(F.col("change").isNotNull())


def delta_counts(delta: DataFrame) -> DataFrame:
    return delta.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "removed")])


def with_previous(snapshots: DataFrame) -> DataFrame:
    """Add the latest strictly earlier snapshot of the same source (ties on time are skipped)."""
    w = Window.partitionBy("source").orderBy("retrieved_at")
    moments = snapshots.groupBy("source", "retrieved_at").agg(F.min("snapshot_id").alias("_first"))
    before = moments.withColumn("previous_id", F.lag("_first").over(w)).drop("_first")
    return snapshots.join(before, ["source", "retrieved_at"])


def current_snapshots(snapshots: DataFrame, records: DataFrame) -> DataFrame:
    """Latest snapshot per source that has person records; smallest id on a tie."""
    held = snapshots.join(records.select("snapshot_id"), "snapshot_id", "left_semi")
    w = Window.partitionBy("source").orderBy(F.desc("retrieved_at"), "snapshot_id")
    return held.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def required_dim(spark: SparkSession, required=REQUIRED_SOURCES) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(required)], "position int, source string")


def list_coverage(current: DataFrame, required: DataFrame, as_of, max_age_days: float = MAX_LIST_AGE_DAYS) -> DataFrame:
    """(source, status): complete when the required list is present and fresh enough."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("retrieved_at").cast("timestamp"))) / F.lit(86_400_000_000.0)
    fresh = F.coalesce(age <= max_age_days, F.lit(False))
    return required.join(current.select("source", "retrieved_at", "snapshot_id"), "source", "left").select(
        "source", F.when(fresh, "complete").otherwise("unavailable").alias("status"), "snapshot_id", "retrieved_at"
    )


def coverage_map(coverage: DataFrame) -> DataFrame:
    """One row: map ``list:<source>`` -> status (as many entries as required lists)."""
    return coverage.agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("list:"), F.col("source")), F.col("status")))).alias("source_status")
    )


def list_steps(current: DataFrame, coverage: DataFrame, required: DataFrame) -> DataFrame:
    """Required lists in their order, then any other list used, in name order."""
    req = required.select("source", F.lit(True).alias("required"), "position")
    used = current.select("source").join(required.select("source"), "source", "left_anti").distinct().select(
        "source", F.lit(False).alias("required"), F.lit(None).cast("int").alias("position"))
    every = req.unionByName(used)
    return (
        every.join(current.select("source", "snapshot_id", "retrieved_at", "content_sha256", "record_count"), "source", "left")
        .join(coverage.select("source", F.col("status").alias("_s")), "source", "left")
        .select("source", "required", "position",
                F.coalesce("_s", F.when(F.col("snapshot_id").isNotNull(), "complete").otherwise("unavailable")).alias("status"),
                "snapshot_id", "retrieved_at", "content_sha256", "record_count")
        .orderBy(F.col("position").asc_nulls_last(), "source")
    )


def retain_newest(snapshots: DataFrame, keep: int = 7) -> DataFrame:
    """The newest ``keep`` (at least one) snapshots per source; ties by created_at, then id."""
    w = Window.partitionBy("source").orderBy(F.desc("retrieved_at"), F.desc("created_at"), F.desc("snapshot_id"))
    return snapshots.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(1, keep)).drop("_n")


def check_ingest(usable: DataFrame, n_skipped: DataFrame, previous_count: int | None,
                 columns: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> DataFrame:
    """One accept/reject row for a parsed extract.

    ``n_skipped`` is a frame of the unusable rows; both counts come from one aggregate.
    """
    missing = [c for c in required if c not in columns]
    both = usable.select(F.lit(1).alias("ok")).unionAll(n_skipped.select(F.lit(0).alias("ok")))
    counts = both.agg(F.count_if(F.col("ok") == 1).alias("records"), F.count_if(F.col("ok") == 0).alias("skipped"))
    total = F.col("records") + F.col("skipped")
    reason = F.when(F.lit(bool(missing)), F.lit("missing columns: " + ", ".join(missing)))
    reason = reason.when(F.col("records") == 0, "no usable rows")
    reason = reason.when((F.col("skipped") > 5) & (F.col("skipped") > total * 0.05), "too many unusable rows")
    if previous_count is not None:
        reason = reason.when(F.col("records") < F.lit(previous_count) * 0.5, "row count collapsed")
    return counts.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def truncate_columns(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Cut strings to their column lengths and count the cuts per row in ``n_truncated``."""
    cut = [F.when(F.length(c) > n, 1).otherwise(0) for c, n in limits.items() if c in df.columns]
    total: Column = reduce(lambda a, b: a + b, cut, F.lit(0))
    out = df.withColumn("n_truncated", total)
    return out.withColumns({c: F.substring(F.col(c), 1, n) for c, n in limits.items() if c in df.columns})
