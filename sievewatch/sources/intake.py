"""Intake validation, idempotency and corrections for submissions and screenings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewatch.functions.geo import company_country
from sievewatch.functions.text import blank_to_null, domain, email

PERSON = "struct<name:string,relationship:string,role:string,dob:string,nationality:string,ownership_pct:double>"
SUBMISSION_SCHEMA = (
    "submission_id string, company_name string, work_email string, company_domain string, country string, tax_id string, "
    "registration_number string, billing_address string, phone string, requester_full_name string, linkedin_url string, "
    f"extra_metadata map<string,string>, people array<{PERSON}>, idempotency_key string, source_ip string, user_agent string, "
    "forwarded_headers string, submitted_at timestamp")
SCREENING_SCHEMA = (
    "subject_id string, name string, original_script_name string, aliases array<string>, dob string, nationality string, "
    "country_of_residence string, pob string, gender string, documents array<struct<type:string,number:string,country:string>>, "
    "address string, kyb_entity_id string, idempotency_key string")
DOB_SHAPE = r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?$"
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s.]+$"
DOC_TYPES = ("passport", "national_id", "tax_id", "other")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSION_SCHEMA).json(path)


def _present(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def _first_reason(checks: list[tuple[Column, str]]) -> Column:
    reasons = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in checks])
    return F.filter(reasons, lambda r: r.isNotNull())


def _split(df: DataFrame, checks: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    judged = df.withColumn("reject_reasons", _first_reason(checks))
    good = judged.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    return good, judged.filter(F.size("reject_reasons") > 0)


def validate_submissions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons). Domains lose scheme and path; tax_id falls back to registration_number."""
    people = F.coalesce("people", F.array().cast(f"array<{PERSON}>"))
    shape = F.forall(people, lambda p: (
        (F.coalesce(F.trim(p["name"]), F.lit("")) != "") & (F.length(p["name"]) <= 256)
        & F.coalesce(p["relationship"].isin("officer", "owner"), F.lit(False))
        & F.coalesce(F.length(p["role"]) <= 128, F.lit(True)) & F.coalesce(F.length(p["nationality"]) <= 64, F.lit(True))
        & F.coalesce(F.trim(p["dob"]).rlike(DOB_SHAPE), F.lit(True))
        & F.coalesce(p["ownership_pct"].between(0, 100), F.lit(True))))
    checks = [
        (_present("company_name"), "company_name"), (_present("company_domain"), "company_domain"),
        (_present("country"), "country"), (F.trim("work_email").rlike(EMAIL_SHAPE), "work_email"),
        (F.size(people) <= 50, "too many people"), (shape, "people"),
        (F.coalesce(F.trim("linkedin_url").rlike(r"(?i)^https?://[^\s/]+"), F.lit(True)), "linkedin_url"),
    ]
    good, bad = _split(raw, checks)
    bare = F.lower(F.trim(F.split(F.regexp_replace("company_domain", r"(?i)^(?:https://)?(?:http://)?", ""), "/")[0]))
    good = good.withColumns({
        "company_domain": bare, "tax_id": F.coalesce(F.nullif("tax_id", F.lit("")), F.col("registration_number")),
        "people": F.transform(people, lambda p: p.withField("name", F.regexp_replace(F.trim(p["name"]), r"\s+", " ")).withField("dob", F.trim(p["dob"]))),
    })
    return good, bad


def validate_screenings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons) for individual screening requests."""
    docs = F.coalesce("documents", F.array().cast("array<struct<type:string,number:string,country:string>>"))
    doc_ok = F.forall(docs, lambda d: (
        F.coalesce(d["type"].isin(*DOC_TYPES), F.lit(False)) & (F.coalesce(F.trim(d["number"]), F.lit("")) != "")
        & (F.length(d["number"]) <= 64) & F.coalesce(F.length(d["country"]) <= 64, F.lit(True))))
    limits = {"name": 512, "original_script_name": 512, "nationality": 64, "country_of_residence": 64, "pob": 256,
              "gender": 32, "address": 1024, "kyb_entity_id": 36}
    checks = [(_present("name"), "name")]
    checks += [(F.coalesce(F.length(c) <= n, F.lit(True)), f"{c} too long") for c, n in limits.items() if c in raw.columns]
    checks += [
        (F.coalesce(F.size("aliases"), F.lit(0)) <= 20, "too many aliases"), (F.size(docs) <= 10, "too many documents"),
        (doc_ok, "documents"), (F.coalesce(F.trim("dob").rlike(DOB_SHAPE), F.lit(True)), "dob"),
    ]
    good, bad = _split(raw, checks)
    return good.withColumns({
        "name": F.trim("name"), "dob": F.trim("dob"),
        "documents": F.transform(docs, lambda d: d.withField("number", F.trim(d["number"]))),
    }), bad


def dedupe_intake(accepted: DataFrame, existing: DataFrame | None = None, order: str = "submitted_at",
                  row_id: str = "submission_id") -> DataFrame:
    """First row per idempotency key that is not stored yet; rows without a key all pass."""
    keyed = accepted.filter(F.col("idempotency_key").isNotNull())
    w = Window.partitionBy("idempotency_key").orderBy(order, row_id)
    first = keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    if existing is not None:
        first = first.join(existing.select("idempotency_key").filter("idempotency_key IS NOT NULL"), "idempotency_key", "left_anti")
    return first.select(*accepted.columns).unionByName(accepted.filter(F.col("idempotency_key").isNull()))


def existing_runs(repeats: DataFrame, stored: DataFrame, runs: DataFrame) -> DataFrame:
    """For repeated keys: the stored submission and its latest run."""
    latest = runs.groupBy("submission_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    known = stored.filter("idempotency_key IS NOT NULL").select("idempotency_key", "submission_id")
    return repeats.select("idempotency_key").distinct().join(known, "idempotency_key").join(latest, "submission_id")


def normalize_submissions(df: DataFrame) -> DataFrame:
    """The normalized fields every producer reads, one row per run."""
    return df.select(
        "run_id", "submission_id", blank_to_null(F.col("company_name")).alias("company_name"), domain(F.col("company_domain")).alias("domain"),
        company_country(F.col("country")).alias("country_iso"), email(F.col("work_email")).alias("email"),
        blank_to_null(F.col("billing_address")).alias("billing_address"), blank_to_null(F.col("tax_id")).alias("tax_id"),
        blank_to_null(F.col("linkedin_url")).alias("linkedin_url"), blank_to_null(F.col("requester_full_name")).alias("requester_full_name"),
        "source_ip")


CORRECTABLE = ("company_name", "company_domain", "work_email", "country", "tax_id", "billing_address", "phone",
               "requester_full_name", "linkedin_url")


def apply_corrections(submissions: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrected submissions, one before/after row per corrected field).

    ``corrections``: submission_id, fields map<string,string>; only keys present in the map change,
    and a key with a NULL value clears the field.
    """
    joined = submissions.join(corrections.select("submission_id", F.col("fields").alias("_f")), "submission_id", "left")
    cols = [c for c in CORRECTABLE if c in submissions.columns]

    def has(c: str) -> Column:
        return F.coalesce(F.map_contains_key("_f", c), F.lit(False))

    changed = joined.select("submission_id", F.explode(F.filter(F.array(*[
        F.when(has(c), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), F.col("_f")[c].alias("after")))
        for c in cols]), lambda x: x.isNotNull())).alias("x")).select("submission_id", "x.*")
    fixed = joined.withColumns({c: F.when(has(c), F.col("_f")[c]).otherwise(F.col(c)) for c in cols}).select(*submissions.columns)
    return fixed, changed
