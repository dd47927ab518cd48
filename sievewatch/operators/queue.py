"""Operator queues and listings: screening runs, reports, audit log, reviews, run chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewatch.functions.names import let
from sievewatch.functions.text import substring_match


def latest_dispositions(dispositions: DataFrame) -> DataFrame:
    """Latest human disposition per decision: newest created_at, then smallest id."""
    w = Window.partitionBy("decision_id").orderBy(F.desc("created_at"), "disposition_id")
    return dispositions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def append_disposition(dispositions: DataFrame, decisions: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejects): only operators and leads may dispose, and only decided runs."""
    known = decisions.select("decision_id", F.lit(True).alias("_decided")).distinct()
    who = roles.select("operator_id", "role")
    checked = dispositions.join(known, "decision_id", "left").join(who, "operator_id", "left")
    allowed = F.coalesce(F.col("role").isin("operator", "lead"), F.lit(False))
    reason = F.when(~allowed, "role").when(F.col("_decided").isNull(), "no decision")
    checked = checked.withColumn("reject_reason", reason)
    return (checked.filter("reject_reason IS NULL").drop("_decided", "role", "reject_reason"),
            checked.filter("reject_reason IS NOT NULL").drop("_decided", "role"))


def queue_rank(disposition: Column) -> Column:
    return (F.when(disposition == "MATCH", 0).when(disposition == "REVIEW", 1)
            .when(disposition == "CLEAR", 2).otherwise(3))


#: (column, descending) of each listing; the last column names a row.
QUEUE_ORDER = (("severity_rank", False), ("created_at", True), ("run_id", False))
REPORT_ORDER = (("created_at", True), ("report_id", False))
AUDIT_ORDER = (("occurred_at", True), ("event_id", False))


def after_row(order: tuple[tuple[str, bool], ...], cursor: dict) -> Column:
    """Rows behind ``cursor`` (a value per column of ``order``), nulls where a sort puts them: first ascending, last descending."""
    behind, same = F.lit(False), F.lit(True)
    for name, descending in order:
        c, v = F.col(name), F.lit(cursor[name])
        if descending:
            further = F.lit(False) if cursor[name] is None else (c < v) | c.isNull()
        else:
            further = c.isNotNull() if cursor[name] is None else c > v
        behind = behind | (same & F.coalesce(further, F.lit(False)))
        same = same & c.eqNullSafe(v)
    return behind


def page(rows: DataFrame, order: tuple[tuple[str, bool], ...], limit: int | None, offset: int = 0, after: dict | None = None) -> DataFrame:
    """A page in ``order``. With ``after``, the cursor of the last row seen, earlier pages are filtered away before the sort, so
    each page costs a top-k of ``limit`` rows, however deep it lies; an offset sorts all rows before it. Without a limit all
    rows come, unsorted."""
    if after is not None:
        rows = rows.where(after_row(order, after))
    if limit is None:
        return rows
    ordered = rows.orderBy(*(F.desc(c) if descending else F.asc(c) for c, descending in order))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def last_row(rows: DataFrame, order: tuple[tuple[str, bool], ...]) -> dict | None:
    """The cursor of a page's last row, None for an empty page: one row reaches the driver."""
    names = [c for c, _ in order]
    found = rows.select(*names).orderBy(*(F.asc(c) if descending else F.desc(c) for c, descending in order)).limit(1).collect()
    return found[0].asDict() if found else None


def screening_queue(runs: DataFrame, decisions: DataFrame, dispositions: DataFrame, *, candidates: DataFrame | None = None,
                    disposition: str | None = None, trigger: str | None = None, older_than_days: int | None = None,
                    list_source: str | None = None, as_of=None, limit: int | None = None, offset: int = 0, after: dict | None = None) -> DataFrame:
    """Runs with their decision and latest human disposition, most severe and newest first.

    ``candidates`` (run_id, source) serves the list filter as a semi-join. ``limit`` gives a page in QUEUE_ORDER, from ``offset``
    or behind the cursor ``after``; Spark plans a top-k instead of a global sort. Without it all rows come.
    """
    q = runs
    if trigger:
        q = q.filter(F.col("trigger") == trigger)
    if older_than_days is not None:
        q = q.filter(F.col("created_at") <= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(older_than_days)))
    if list_source:
        q = q.join(candidates.filter(F.col("source") == list_source).select("run_id"), "run_id", "left_semi")
    d = decisions.select("run_id", "decision_id", F.col("disposition").alias("system_disposition"), "auto_closed", "top_score")
    if disposition:
        q = q.join(d.filter(F.col("system_disposition") == disposition), "run_id")
    else:
        q = q.join(d, "run_id", "left")
    human = latest_dispositions(dispositions).select("decision_id", F.col("disposition").alias("human_disposition"))
    q = q.join(human, "decision_id", "left").withColumn("severity_rank", queue_rank(F.col("system_disposition")))
    return page(q, QUEUE_ORDER, limit, offset, after)


def visible_runs(runs: DataFrame, subjects: DataFrame, client_id: str | None = None) -> DataFrame:
    """Operators (no client id) see every run; an API client only the runs it submitted."""
    if client_id is None:
        return runs
    mine = subjects.filter(F.col("api_client_id") == client_id).select("subject_id")
    return runs.join(mine, "subject_id", "left_semi")


def report_list(reports: DataFrame, runs: DataFrame, submissions: DataFrame, assessments: DataFrame, reviews: DataFrame, *,
                triage_tier: str | None = None, review_status: str | None = None, q: str | None = None,
                limit: int | None = None, offset: int = 0, after: dict | None = None) -> DataFrame:
    """Reports joined to run and submission, outer to assessment and review, newest first."""
    subs = submissions.select("submission_id", "company_name", "domain")
    if q:
        subs = subs.filter(substring_match(F.col("company_name"), q) | substring_match(F.col("domain"), q))
    scored = assessments.select("run_id", "overall_score", "triage_tier")
    seen = reviews.select("run_id", F.col("status").alias("review_status"), F.lit(True).alias("_reviewed"))
    rows = (
        reports.select("report_id", "run_id", F.col("status").alias("report_status"), "created_at")
        .join(runs.select("run_id", "submission_id"), "run_id").join(subs, "submission_id")
        .join(scored, "run_id", "left").join(seen, "run_id", "left")
    )
    if triage_tier:
        rows = rows.filter(F.col("triage_tier") == triage_tier)
    if review_status == "pending":
        rows = rows.filter(F.col("_reviewed").isNull())
    elif review_status == "reviewed":
        rows = rows.filter(F.col("_reviewed").isNotNull())
    rows = rows.drop("_reviewed")
    return page(rows, REPORT_ORDER, limit, offset, after)


def total(filtered: DataFrame) -> DataFrame:
    """Row count over all pages."""
    return filtered.agg(F.count("*").alias("total"))


def run_timing(runs: DataFrame) -> DataFrame:
    """Duration in seconds of every finished run."""
    return runs.withColumn("duration_seconds", (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(1e6))


def stage_map(outcomes: DataFrame) -> DataFrame:
    """(run_id, stages): map of stage -> its latest status, from rows (run_id, stage, status, at).

    Of outcomes at one moment the greatest status counts; rows without a stage are left out.
    """
    latest = outcomes.filter("stage IS NOT NULL").groupBy("run_id", "stage").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
    return latest.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "status")))).alias("stages"))


def run_panel(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Runs with duration and stage map; a run without outcomes has an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return run_timing(runs).join(stage_map(outcomes), "run_id", "left").withColumn("stages", F.coalesce("stages", empty))


def latest_run(runs: DataFrame, key: str = "entity_id") -> DataFrame:
    """Newest run per key by (created_at, run_id)."""
    return runs.groupBy(key).agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def score_history(runs: DataFrame, assessments: DataFrame) -> DataFrame:
    """Each run next to the run it supersedes, with the change of the overall score."""
    scores = assessments.select("run_id", "overall_score", "triage_tier")
    mine = runs.select("run_id", "submission_id", "supersedes_id", "created_at").join(scores, "run_id", "left")
    old = scores.select(F.col("run_id").alias("supersedes_id"), F.col("overall_score").alias("previous_score"),
                        F.col("triage_tier").alias("previous_tier"))
    return mine.join(old, "supersedes_id", "left").withColumn(
        "score_change", F.round(F.col("overall_score") - F.col("previous_score"), 4))


def score_lag(runs: DataFrame, assessments: DataFrame, key: str = "submission_id") -> DataFrame:
    """Score history by time: the previous run of the same submission."""
    w = Window.partitionBy(key).orderBy("created_at", "run_id")
    return (runs.join(assessments.select("run_id", "overall_score"), "run_id", "left")
            .withColumn("previous_run_id", F.lag("run_id").over(w))
            .withColumn("previous_score", F.lag("overall_score").over(w)))


def latest_review(reviews: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest review decision per submission across all of its runs."""
    return (reviews.filter(F.col("decided_at").isNotNull()).join(runs.select("run_id", "submission_id"), "run_id")
            .groupBy("submission_id").agg(F.max("decided_at").alias("decided_at")))


def apply_reviews(reviews: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge review actions: one review per run, notes appended, corrections merged.

    ``reviews``: run_id, status, notes, corrections map, decided_at. ``actions``: run_id, kind
    (``mark`` or ``note``), status?, notes?, corrections?, acted_at. A second mark is rejected.
    The fold is ordered by time within a run; a run has a handful of actions.
    """
    w = Window.partitionBy("run_id").orderBy("acted_at", "action_id")
    marked = reviews.filter(F.col("status").isNotNull()).select("run_id", F.lit(True).alias("_has"))
    ranked = actions.withColumn("_mark", F.sum(F.when(F.col("kind") == "mark", 1).otherwise(0)).over(w))
    ranked = ranked.join(marked, "run_id", "left")
    bad = (F.col("kind") == "mark") & (F.col("_has").isNotNull() | (F.col("_mark") > 1))
    good = ranked.filter(~bad)
    step = F.struct("acted_at", "action_id", "kind", "status", "notes", F.to_json("corrections").alias("corrections"))
    folded = good.groupBy("run_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    empty = F.create_map().cast("map<string,string>")
    merged = reviews.join(folded, "run_id", "full_outer").withColumn("steps", F.coalesce("steps", F.array().cast(folded.schema["steps"].dataType)))

    def last(field: str) -> Column:
        return F.try_element_at(F.filter(F.transform("steps", lambda s: s[field]), lambda v: v.isNotNull()), F.lit(-1))

    texts = F.filter(F.concat(F.array("notes"), F.transform("steps", lambda s: s["notes"])), lambda n: F.coalesce(n, F.lit("")) != "")
    corrections = F.aggregate(
        "steps", F.coalesce("corrections", empty),
        lambda acc, s: let(F.coalesce(F.from_json(s["corrections"], "map<string,string>"), empty), lambda new: F.map_concat(
            F.map_filter(acc, lambda k, _v: ~F.map_contains_key(new, k)), new)))
    first_mark = F.try_element_at(F.filter("steps", lambda s: s["kind"] == "mark"), F.lit(1))
    out = merged.select(
        "run_id", F.coalesce(last("status"), F.col("status")).alias("status"),
        F.nullif(F.array_join(texts, "\n"), F.lit("")).alias("notes"), corrections.alias("corrections"),
        F.coalesce("decided_at", first_mark["acted_at"]).alias("decided_at"))
    return out, ranked.filter(bad).drop("_mark", "_has")


def audit_timeline(events: DataFrame, run_id: str, submission_id: str) -> DataFrame:
    """Events of one run or of its submission, oldest first."""
    hit = (F.col("verification_run_id") == run_id) | (F.col("submission_id") == submission_id)
    return events.filter(hit).orderBy("occurred_at", "event_id")


def audit_log(events: DataFrame, event_type: str | None = None, limit: int | None = None, after: dict | None = None) -> DataFrame:
    """Events newest first, optionally of one type: a page of ``limit`` rows behind the cursor ``after``, or all."""
    rows = events.filter(F.col("event_type") == event_type) if event_type else events
    return page(rows, AUDIT_ORDER, limit, after=after)


def with_actor(events: DataFrame, operators: DataFrame, clients: DataFrame) -> DataFrame:
    """Actor of each event: operator e-mail, else client name, else integration or system."""
    ops = operators.select("operator_id", F.col("email").alias("_email"))
    cli = clients.select("api_client_id", F.col("name").alias("_client"))
    actor = F.coalesce("_email", "_client", F.when(F.col("api_client_id").isNotNull(), "integration").otherwise("system"))
    return (events.join(ops, "operator_id", "left").join(cli, "api_client_id", "left")
            .withColumn("actor", actor).drop("_email", "_client"))


def audit_event(df: DataFrame, event_type: str, payload: list[str], as_of, keys: list[str] | None = None) -> DataFrame:
    """Audit rows for a batch: the payload holds the given columns only (ids and counts, no names)."""
    ids = [F.col(c).cast("string") for c in (keys or payload)]
    return df.select(
        F.sha2(F.concat_ws("|", F.lit(event_type), F.lit(str(as_of)), *ids), 256).alias("event_id"),
        F.lit(event_type).alias("event_type"), F.to_json(F.struct(*payload)).alias("payload"),
        F.lit(as_of).cast("timestamp").alias("occurred_at"))
