"""Submitted versus discovered values, one comparison per field spec and run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewatch.functions.text import bare_host, names_match

# Street words ignored when comparing addresses.
ADDRESS_NOISE = ("the", "of", "and", "st", "street", "ave", "avenue", "rd", "road", "blvd")
ADDRESS_OVERLAP = 0.4


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " "))


def name_contains(a: Column, b: Column) -> Column:
    """Either name holds the other, ignoring case and spacing."""
    x, y = _norm(a), _norm(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def iso_prefix(a: Column, b: Column) -> Column:
    """Equal, or one a prefix of the other ("US" and "US_CA")."""
    x, y = F.upper(_norm(a)), F.upper(_norm(b))
    return (x != "") & (y != "") & (x.startswith(y) | y.startswith(x))


def address_overlap(a: Column, b: Column) -> Column:
    """Significant words of the shorter address covered to at least 40 %."""
    x, y = _norm(a), _norm(b)
    noise = F.array(*[F.lit(w) for w in ADDRESS_NOISE])
    xs, ys = (F.array_except(F.split(v, " "), noise) for v in (x, y))
    smaller = F.least(F.size(xs), F.size(ys))
    share = F.size(F.array_intersect(xs, ys)) / F.nullif(smaller, F.lit(0))
    return (x != "") & (y != "") & F.when(smaller == 0, F.contains(x, y) | F.contains(y, x)).otherwise(share >= ADDRESS_OVERLAP)


def tax_resolves(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) != "") & _norm(b).isin("verified", "inactive")


def host_related(a: Column, b: Column) -> Column:
    """Same host, or one a subdomain of the other."""
    x, y = bare_host(a), bare_host(b)
    dot = F.lit(".")
    return F.coalesce((x == y) | y.endswith(F.concat(dot, x)) | x.endswith(F.concat(dot, y)), F.lit(False))


# (comparison name, submitted column, evidence field) -> match function of (submitted, discovered)
FIELD_SPECS: dict[tuple[str, str, str], Callable[[Column, Column], Column]] = {
    ("company_name", "company_name", "company_name"): name_contains,
    ("country_iso", "country_iso", "jurisdiction"): iso_prefix,
    ("billing_address", "billing_address", "legal_address"): address_overlap,
    ("tax_id", "tax_id", "tax_id_status"): tax_resolves,
    ("tax_id_registered_name", "company_name", "tax_id_registered_name"): names_match,
    ("linkedin_website", "domain", "linkedin_website"): host_related,
}


def compare_fields(subs: DataFrame, evidence: DataFrame, specs=None) -> DataFrame:
    """One row per run and spec: match, mismatch or unverified, with the supporting evidence.

    The evidence is filtered to the compared fields before the join. Per run and spec only the
    best row survives the map-side aggregate: matching first, then the oldest.
    """
    specs = specs or FIELD_SPECS
    wanted = subs.select("run_id", F.explode(F.array(*[
        F.struct(F.lit(name).alias("field_name"), F.col(col).cast("string").alias("submitted_value"), F.lit(field).alias("field"))
        for name, col, field in specs])).alias("s")).select("run_id", "s.*")
    fields = sorted({field for _n, _c, field in specs})
    found = evidence.filter(F.col("field").isin(*fields)).select(
        "run_id", "field", "evidence_id", "created_at",
        F.coalesce(F.nullif("normalized_value", F.lit("")), F.col("raw_value")).alias("discovered_value"))
    matched = reduce(
        lambda acc, kv: acc.when(F.col("field_name") == kv[0][0], kv[1](F.col("submitted_value"), F.col("discovered_value"))),
        list(specs.items())[1:],
        F.when(F.col("field_name") == next(iter(specs))[0], next(iter(specs.values()))(F.col("submitted_value"), F.col("discovered_value"))))
    joined = wanted.join(found, ["run_id", "field"], "left").withColumn("_miss", ~F.coalesce(matched, F.lit(False)))
    order = F.struct("_miss", "created_at", "evidence_id")
    best = joined.groupBy("run_id", "field_name", "submitted_value").agg(
        F.min_by(F.struct("evidence_id", "discovered_value", "_miss"), F.when(F.col("evidence_id").isNotNull(), order)).alias("b"))
    status = F.when(F.col("b.evidence_id").isNull(), "unverified").when(F.col("b._miss"), "mismatch").otherwise("match")
    return best.select(
        F.sha2(F.concat_ws("|", F.col("run_id").cast("string"), "field_name"), 256).alias("comparison_id"), "run_id",
        "b.evidence_id", "field_name", "submitted_value", "b.discovered_value", status.alias("match_status"))
