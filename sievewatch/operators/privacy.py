"""Retention, anonymization and role-based redaction as projections and semi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewatch.functions.text import truncate_ip
from sievewatch.operators.queue import latest_review

# Retention windows in days and the placeholder of an erased address.
NETWORK_DAYS, REVIEWED_DAYS, UNREVIEWED_DAYS = 90, 1825, 180
ANONYMIZED_EMAIL = "redacted@anonymized.invalid"
PII_FIELDS = ("tax_id", "billing_address", "phone", "requester_full_name", "linkedin_url", "declared_people")
NETWORK_SOURCE = "ipinfo"
REQUESTER_FIELDS = ("linkedin_requester_match",)
CONTACT_MISMATCH_FIELDS = ("billing_address",)
PUBLIC_RECORDS_SOURCE = "public_records"
REDACTED = "[redacted]"


def _cutoff(as_of, days: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def network_due(as_of, days: int = NETWORK_DAYS) -> Column:
    """Raw network metadata older than the window and not anonymized yet."""
    raw_ip = F.col("source_ip").isNotNull() & ~F.contains(F.col("source_ip"), F.lit("/"))
    left = F.col("user_agent").isNotNull() | F.col("forwarded_headers").isNotNull() | raw_ip
    return (F.col("submitted_at") <= _cutoff(as_of, days)) & F.coalesce(left, F.lit(False))


def anonymize_network(submissions: DataFrame, as_of, days: int = NETWORK_DAYS) -> DataFrame:
    """Truncate old IPs and drop their headers; running it again changes nothing."""
    due = network_due(as_of, days)
    return submissions.withColumn("_due", due).withColumns({
        "source_ip": F.when(F.col("_due"), truncate_ip(F.col("source_ip"))).otherwise(F.col("source_ip")),
        "user_agent": F.when(~F.col("_due"), F.col("user_agent")),
        "forwarded_headers": F.when(~F.col("_due"), F.col("forwarded_headers")),
    }).withColumnRenamed("_due", "network_anonymized")


def retention_due(submissions: DataFrame, reviews: DataFrame, runs: DataFrame, as_of,
                  reviewed_days: int = REVIEWED_DAYS, unreviewed_days: int = UNREVIEWED_DAYS) -> DataFrame:
    """Submissions with ``due`` in reviewed | unreviewed | NULL."""
    live = F.col("work_email") != ANONYMIZED_EMAIL
    due = (
        F.when(live & (F.col("decided_at") <= _cutoff(as_of, reviewed_days)), "reviewed")
        .when(live & F.col("decided_at").isNull() & (F.col("submitted_at") <= _cutoff(as_of, unreviewed_days)), "unreviewed")
    )
    return submissions.join(latest_review(reviews, runs), "submission_id", "left").withColumn("due", due).drop("decided_at")


def anonymize_pii(due: DataFrame) -> DataFrame:
    """Erase the submitter's personal fields where ``due`` is set; company fields stay."""
    hit = F.col("due").isNotNull()
    cleared = {c: F.when(~hit, F.col(c)) for c in PII_FIELDS if c in due.columns}
    return due.withColumns({**cleared, "work_email": F.when(hit, ANONYMIZED_EMAIL).otherwise(F.col("work_email"))})


def anonymized_submissions(submissions: DataFrame, due: DataFrame) -> DataFrame:
    """Ids anonymized earlier or in this pass."""
    earlier = submissions.filter(F.col("work_email") == ANONYMIZED_EMAIL).select("submission_id")
    return earlier.union(due.filter("due IS NOT NULL").select("submission_id")).distinct()


def scrub_evidence(evidence: DataFrame, runs: DataFrame, anonymized: DataFrame) -> DataFrame:
    """Remove names of associated people from social-page payloads of anonymized submissions."""
    hit = runs.join(anonymized, "submission_id", "left_semi").select("run_id", F.lit(True).alias("_hit")).distinct()
    payload = F.from_json("raw_payload", "map<string,string>")
    has = F.coalesce(F.map_contains_key(payload, "associated_people"), F.lit(False))
    target = F.col("_hit").isNotNull() & (F.col("field") == "linkedin_presence") & has
    clean = F.to_json(F.map_filter(payload, lambda k, _v: k != "associated_people"))
    return (evidence.join(hit, "run_id", "left").withColumn("scrubbed", F.coalesce(target, F.lit(False)))
            .withColumn("raw_payload", F.when(F.col("scrubbed"), clean).otherwise(F.col("raw_payload"))).drop("_hit"))


def retention_counts(submissions: DataFrame, due: DataFrame, evidence_scrubbed: DataFrame, as_of) -> DataFrame:
    """One row with the counts of a retention pass."""
    network = submissions.agg(F.count_if(network_due(as_of)).alias("n")).select(F.lit("network_metadata").alias("category"), "n")
    pii = due.filter("due IS NOT NULL").groupBy(F.concat("due", F.lit("_pii")).alias("category")).agg(F.count("*").alias("n"))
    scrub = evidence_scrubbed.agg(F.count_if("scrubbed").alias("n")).select(F.lit("requester_association").alias("category"), "n")
    return network.unionByName(pii).unionByName(scrub)


def names_a_person(kind: Column, match: Column, classification: Column, field: Column) -> Column:
    """A public record that is not a strong match to the company itself may name a person."""
    company = (F.coalesce(match == "strong", F.lit(False)) & F.coalesce(kind.isin("bankruptcy", "federal_exclusion"), F.lit(False))
               & ~F.coalesce(classification == "Individual", F.lit(False)))
    return (field == "public_record") & ~company


def redact_evidence(evidence: DataFrame, viewer: str) -> DataFrame:
    """Evidence rows as a lead, an operator or an integration (``system``) may see them."""
    network = F.col("source") == NETWORK_SOURCE
    if viewer == "lead":
        return evidence
    attribution = F.from_json("attribution", "map<string,string>")
    if viewer == "operator":
        kept = F.to_json(F.map_filter(attribution, lambda k, _v: k != "source_url"))
        return evidence.withColumn("attribution", F.when(network & attribution.isNotNull(), kept).otherwise(F.col("attribution")))
    payload = F.from_json("raw_payload", "map<string,string>")
    person = (F.col("source") == PUBLIC_RECORDS_SOURCE) & names_a_person(
        payload["kind"], payload["match"], payload["classification"], F.col("field"))
    masked = F.map_concat(F.map_filter(payload, lambda k, _v: k != "party_name"),
                          F.create_map(F.lit("party_name"), F.lit(REDACTED)))
    return evidence.filter(~network & ~F.col("field").isin(*REQUESTER_FIELDS)).withColumn(
        "raw_payload", F.when(person, F.to_json(masked)).otherwise(F.col("raw_payload")))


def redact_mismatches(comparisons: DataFrame, viewer: str) -> DataFrame:
    return comparisons.filter(~F.col("field_name").isin(*CONTACT_MISMATCH_FIELDS)) if viewer == "system" else comparisons


def redact_sources(sources: DataFrame, viewer: str) -> DataFrame:
    return sources.filter(F.col("source") != NETWORK_SOURCE) if viewer == "system" else sources


def pii_flags(evidence: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(run_id, has_pii): network, requester, person-naming records or a contact mismatch."""
    payload = F.from_json("raw_payload", "map<string,string>")
    person = (F.col("source") == PUBLIC_RECORDS_SOURCE) & names_a_person(
        payload["kind"], payload["match"], payload["classification"], F.col("field"))
    from_evidence = evidence.select("run_id", ((F.col("source") == NETWORK_SOURCE) | F.col("field").isin(*REQUESTER_FIELDS) | person).alias("_p"))
    from_mismatch = comparisons.filter(F.col("match_status") == "mismatch").select("run_id", F.col("field_name").isin(*CONTACT_MISMATCH_FIELDS).alias("_p"))
    return from_evidence.unionAll(from_mismatch).groupBy("run_id").agg(F.bool_or(F.coalesce("_p", F.lit(False))).alias("has_pii"))
