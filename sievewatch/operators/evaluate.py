"""Matcher evaluation on labelled cases: recall, false positives, abstention, reproducibility, gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATES = {"blocking_recall": 1.0, "reproducibility": 1.0}


def labelled_pairs(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Expected hits next to whether blocking found them: (subject_id, record_id, found)."""
    truth = cases.select("subject_id", F.explode("expected_hits").alias("record_id"))
    found = candidates.select("subject_id", "record_id", F.lit(True).alias("_f")).distinct()
    return truth.join(found, ["subject_id", "record_id"], "left").select("subject_id", "record_id", F.coalesce("_f", F.lit(False)).alias("found"))


def missed_pairs(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    return labelled_pairs(cases, candidates).filter(~F.col("found")).select("subject_id", "record_id")


def evaluate(cases: DataFrame, watchlist: DataFrame, blocker: Callable[[DataFrame, DataFrame], DataFrame],
             scorer: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """One metrics row. ``blocker(cases, watchlist)`` -> (subject_id, record_id); ``scorer(pairs, cases, watchlist)`` adds score."""
    pairs = blocker(cases, watchlist).select("subject_id", "record_id").distinct()
    labels = labelled_pairs(cases, pairs)
    recall = labels.agg(F.count("*").alias("true_pairs"), F.count_if("found").alias("found"))
    size = cases.agg(F.count("*").alias("cases"))
    volume = pairs.agg(F.count("*").alias("candidates"))
    one = F.lit(1).alias("_one")

    def tagged(df: DataFrame) -> DataFrame:
        return df.select("*", one)

    # One-row aggregates meet on a constant key.
    out = tagged(recall).join(tagged(size), "_one").join(tagged(volume), "_one")
    out = out.withColumn("blocking_recall", F.when(F.col("true_pairs") > 0, F.col("found") / F.col("true_pairs")).otherwise(1.0))
    out = out.withColumn("candidates_per_case", F.round(F.col("candidates") / F.greatest("cases", F.lit(1)), 3))
    if scorer is not None:
        scored = scorer(pairs, cases, watchlist).select("subject_id", "record_id", "score")
        truth = cases.select("subject_id", F.explode("expected_hits").alias("record_id"), F.lit(True).alias("_hit"))
        marked = scored.join(truth, ["subject_id", "record_id"], "left").withColumn("is_hit", F.coalesce("_hit", F.lit(False)))
        threshold = marked.filter("is_hit").agg(F.min("score").alias("threshold"))
        others = marked.filter(~F.col("is_hit")).select("score", one).join(F.broadcast(tagged(threshold)), "_one")
        fp = others.agg(F.count("*").alias("others"), F.count_if(F.col("score") >= F.col("threshold")).alias("flagged"))
        out = out.join(tagged(threshold), "_one").join(tagged(fp), "_one")
        ok = (F.col("blocking_recall") == 1.0) & F.col("threshold").isNotNull()
        out = out.withColumn("fp_rate_at_full_recall", F.when(ok, F.when(F.col("others") > 0, F.col("flagged") / F.col("others")).otherwise(0.0)))
        out = out.withColumn("threshold_at_full_recall", F.when(ok, F.col("threshold"))).drop("threshold", "others", "flagged")
    return out.drop("_one", "true_pairs", "found", "candidates")


def disposition_metrics(cases: DataFrame, decisions: DataFrame, again: DataFrame) -> DataFrame:
    """Per category and in total: cases, dispositions, abstention, coverage and reproducibility.

    ``again`` is a second run of the same decisions; one ``rollup`` gives categories and the total.
    """
    second = again.select("subject_id", F.struct("disposition", "auto_closed").alias("_again"))
    rows = cases.select("subject_id", "category").join(decisions, "subject_id").join(second, "subject_id", "left")
    same = F.coalesce(F.struct("disposition", "auto_closed") == F.col("_again"), F.lit(False))
    covered = ~F.coalesce(F.exists(F.map_values("source_status"), lambda v: v == "unavailable"), F.lit(False))
    out = rows.rollup("category").agg(
        F.count("*").alias("cases"), *[F.count_if(F.col("disposition") == d).alias(d.lower()) for d in ("CLEAR", "REVIEW", "MATCH")],
        F.round(F.count_if(F.col("disposition") == "REVIEW") / F.count("*"), 4).alias("abstention_rate"),
        F.round(F.count_if(covered) / F.count("*"), 4).alias("coverage"),
        F.round(F.count_if(same) / F.count("*"), 4).alias("reproducibility"))
    return out.withColumn("category", F.coalesce("category", F.lit("(all)")))


def category_pivot(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Dispositions per category as columns."""
    return (cases.select("subject_id", "category").join(decisions.select("subject_id", "disposition"), "subject_id")
            .groupBy("category").pivot("disposition", ["CLEAR", "REVIEW", "MATCH"]).count().na.fill(0))


def gate(metrics: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, target) of every gated metric below its target; empty means pass."""
    wanted = gates or GATES
    cols = [m for m in wanted if m in metrics.columns]
    rows = metrics.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value"), F.lit(float(wanted[m])).alias("target"))
        for m in cols])).alias("g")).select("g.*")
    return rows.filter(F.col("value") < F.col("target"))


def alert_rate(decisions: DataFrame) -> DataFrame:
    """Alerts (not auto-closed) per thousand screenings."""
    return decisions.agg(F.count("*").alias("screenings"), F.count_if(~F.col("auto_closed")).alias("alerts")).withColumn(
        "alerts_per_1000", F.round(F.col("alerts") * 1000 / F.nullif("screenings", F.lit(0)), 3))


def time_to_disposition(decisions: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Median and 95th percentile (exact, discrete) of the hours from decision to the first human disposition.

    Equal durations are counted first, then ranked in two steps: running totals over whole days, one row per day, and
    running totals within each day. No step sorts all rows in one task.
    """
    first = dispositions.groupBy("decision_id").agg(F.min("created_at").alias("_first"))
    hours = (F.unix_micros(F.col("_first").cast("timestamp")) - F.unix_micros(F.col("decided_at").cast("timestamp"))) / F.lit(3_600_000_000.0)
    counts = decisions.join(first, "decision_id").groupBy(hours.alias("hours")).agg(F.count("*").alias("n")).withColumn("day", F.floor(F.col("hours") / 24))
    days = counts.groupBy("day").agg(F.sum("n").alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    total = counts.agg(F.sum("n").alias("total"))
    within = Window.partitionBy("day").orderBy("hours").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(within)).join(days, "day").withColumn("upto", F.col("upto") + F.col("before"))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.lit(share) * F.col("total"), F.col("hours")))

    return ranked.crossJoin(F.broadcast(total)).agg(  # the total is one row
        F.coalesce(F.sum("n"), F.lit(0)).alias("disposed"), at(0.5).alias("median_hours"), at(0.95).alias("p95_hours"))
