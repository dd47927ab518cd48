"""Proof checks of domain-ownership challenges against landed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewatch.sources.evidence import emit, item

TXT_PREFIX = "domain-proof="
META_NAME = "domain-proof"


def verify_ownership(challenges: DataFrame, txt: DataFrame, pages: DataFrame, mail_tokens: DataFrame,
                     txt_prefix: str = TXT_PREFIX, meta_name: str = META_NAME) -> DataFrame:
    """Challenges with ``proved``: a DNS record holds, or the first page tag or a mailed token equals, the issued token.

    ``challenges``: challenge_id, run_id, domain, method (dns_txt | html_meta | email), token, status.
    """
    expected = F.concat(F.lit(txt_prefix), F.col("token"))
    said = (challenges.filter("method = 'dns_txt'").select("challenge_id", "domain", "token").join(txt.select("domain", "value").distinct(), "domain")
            .filter(F.contains("value", expected)).select("challenge_id").distinct().withColumn("_said", F.lit(True)))
    page = pages.groupBy("domain").agg(F.max_by("html", "fetched_at").alias("_html"))
    mailed = mail_tokens.select("challenge_id", "token").distinct().withColumn("_mailed", F.lit(True))
    rows = challenges.join(said, "challenge_id", "left").join(page, "domain", "left").join(mailed, ["challenge_id", "token"], "left")
    name = meta_name.replace("-", r"\-")
    forward = rf"(?is)<meta[^>]+name\s*=\s*[\"']{name}[\"'][^>]+content\s*=\s*[\"']([^\"']+)[\"']"
    backward = rf"(?is)<meta[^>]+content\s*=\s*[\"']([^\"']+)[\"'][^>]+name\s*=\s*[\"']{name}[\"']"
    meta = F.coalesce(F.nullif(F.regexp_extract("_html", forward, 1), F.lit("")), F.regexp_extract("_html", backward, 1))
    proved = (
        F.when(F.col("method") == "dns_txt", F.col("_said"))
        .when(F.col("method") == "html_meta", F.trim(meta) == F.col("token"))
        .when(F.col("method") == "email", F.col("_mailed")))
    return rows.withColumn("proved", F.coalesce(proved, F.lit(False))).select(*challenges.columns, "proved")


def ownership_evidence(verified: DataFrame, existing: DataFrame, as_of) -> DataFrame:
    """Tier-3 evidence for newly proved challenges; a run that has the row already gets no second one."""
    fresh = verified.filter("proved").dropDuplicates(["run_id", "method"])
    have = existing.filter(F.col("field") == "domain_ownership_verified").select("run_id", F.col("raw_value").alias("method"))
    rows = fresh.join(have, ["run_id", "method"], "left_anti")
    return emit(rows, "ownership", 3, [item("domain_ownership_verified", F.col("method"), normalized=F.lit("true"), confidence=0.6,
                                            payload=F.to_json(F.struct("domain", "method")))], as_of)
