"""Registered queries: list files written from the driver tables and read back by the list readers, ingest guards, intake."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewatch.functions.text import numbered
from sievewatch.operators import lists
from sievewatch.plans.base import pick, query, sql_pick, table
from sievewatch.session import ensure_checkpoint_dir
from sievewatch.sources import intake
from sievewatch.sources import lists as files

ENDS = ("Indefinite", "", "2030-01-31", "12/31/2029")


def _written(spark: SparkSession, rows: DataFrame, header: bool) -> str:
    """``rows`` as CSV files in the shared folder, quoted like the published files."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/list-files/{uuid.uuid4().hex}"
    rows.write.csv(path, header=header, quote='"', escape='"', quoteAll=True)
    return path


@query("exclusions_file", f"""
WITH p AS (SELECT p_partkey AS k, {sql_pick(ENDS, 'p_partkey % 4')} AS e FROM part)
SELECT CASE WHEN k % 13 = 0 THEN '' ELSE 'S4' || k END AS sam_number, CASE WHEN k % 11 = 0 THEN '' ELSE 'Harbor "' || k || '", Inc.' END AS name,
       CASE WHEN k % 11 = 0 THEN 'Ann' ELSE '' END AS first, CASE WHEN k % 11 = 0 THEN 'Lee' || k ELSE '' END AS last, 'Main, ' || (k % 9) AS city, DATE '2001-02-03' + (k % 20)::INT AS active_date,
       CASE e WHEN '2030-01-31' THEN DATE '2030-01-31' WHEN '12/31/2029' THEN DATE '2029-12-31' END AS termination_date, e = 'Indefinite' AS termination_indefinite,
       CASE WHEN k % 5 = 0 THEN 'also' || chr(10) || 'known' ELSE 'A; B' || k END AS cross_reference, k % 13 > 0 AS usable FROM p""")
def exclusions_file(spark, sf_dir):
    """An extract with quotes, commas, line breaks, two date forms, people without a company name and rows without a number."""
    k = F.col("p_partkey")
    text = k.cast("string")
    day = F.date_add(F.lit("2001-02-03").cast("date"), (k % 20).cast("int"))
    held = {
        "Classification": F.lit("Firm"), "Name": F.when(k % 11 != 0, F.concat(F.lit('Harbor "'), text, F.lit('", Inc.'))), "First": F.when(k % 11 == 0, "Ann"),
        "Last": F.when(k % 11 == 0, F.concat(F.lit("Lee"), text)), "City": F.concat(F.lit(" Main, "), (k % 9).cast("string"), F.lit("  ")),
        "Active Date": F.when(k % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "MM/dd/yyyy")), "Termination Date": pick(ENDS, k % 4),
        "Cross-Reference": F.when(k % 5 == 0, "also\nknown").otherwise(F.concat(F.lit("A; B"), text)), "SAM Number": F.when(k % 13 != 0, F.concat(F.lit("S4"), text)),
    }
    rows = table(spark, sf_dir, "part").select(*(F.coalesce(held.get(c, F.lit("")), F.lit("")).alias(c) for c in files.EXCLUSION_COLUMNS))
    good, bad = files.read_exclusions(spark, _written(spark, rows, True))
    both = good.withColumn("usable", F.lit(True)).unionByName(bad.withColumn("usable", F.lit(False)))
    return both.select("sam_number", "name", "first", "last", "city", "active_date", "termination_date", "termination_indefinite", "cross_reference", "usable")


@query("sdn_file", """
SELECT p_partkey::VARCHAR AS id, 'PETROV, Ivan "' || p_partkey || '"' AS name, CASE WHEN p_partkey % 3 > 0 THEN 'individual' END AS sdn_type, CASE WHEN p_partkey % 4 > 0 THEN 'SDGT' END AS program,
       CASE WHEN p_partkey % 5 > 0 THEN 'DOB 1 Jan ' || (1950 + p_partkey % 40) || '; nationality Ruritania.' END AS remarks FROM part WHERE p_partkey % 17 > 0""")
def sdn_file(spark, sf_dir):
    """The twelve columns without a header, ``-0-`` for nothing, and rows without a name, which are dropped."""
    k = F.col("p_partkey")
    text, nothing = k.cast("string"), F.lit("-0- ")
    held = [
        text, F.when(k % 17 > 0, F.concat(F.lit('PETROV, Ivan "'), text, F.lit('"'))).otherwise(" "), F.when(k % 3 > 0, "individual").otherwise(nothing),
        F.when(k % 4 > 0, "SDGT").otherwise(nothing), *[nothing] * 7,
        F.when(k % 5 > 0, F.concat(F.lit("DOB 1 Jan "), (1950 + k % 40).cast("string"), F.lit("; nationality Ruritania."))).otherwise(nothing),
    ]
    return files.read_sdn(spark, _written(spark, table(spark, sf_dir, "part").select(*(c.alias(f"c{i}") for i, c in enumerate(held))), False))


@query("ingest_guards", """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 40 = 0) AS few, count(*) FILTER (WHERE p_partkey % 10 = 0) AS many FROM part)
SELECT 'whole' AS extract, n - few AS records, few AS skipped, NULL AS reason, true AS accepted FROM n UNION ALL SELECT 'columns', n - few, few, 'missing columns: uei, cage', false FROM n
UNION ALL SELECT 'empty', 0, few, 'no usable rows', false FROM n UNION ALL SELECT 'broken', n - many, many, 'too many unusable rows', false FROM n
UNION ALL SELECT 'collapsed', n - few, few, 'row count collapsed', false FROM n UNION ALL SELECT 'smaller', n - few, few, NULL, true FROM n""")
def ingest_guards(spark, sf_dir):
    """Every branch of the guard: accepted, missing columns, nothing usable, too much unusable, a collapse, and a smaller extract that passes."""
    rows = table(spark, sf_dir, "part").select("p_partkey")
    few, many = F.col("p_partkey") % 40 == 0, F.col("p_partkey") % 10 == 0
    n = rows.count()  # what the stored snapshot had
    checks = {
        "whole": lists.check_ingest(rows.where(~few), rows.where(few), None), "columns": lists.check_ingest(rows.where(~few), rows.where(few), None, ("name",), ("name", "uei", "cage")),
        "empty": lists.check_ingest(rows.where("false"), rows.where(few), n), "broken": lists.check_ingest(rows.where(~many), rows.where(many), n),
        "collapsed": lists.check_ingest(rows.where(~few), rows.where(few), 3 * n), "smaller": lists.check_ingest(rows.where(~few), rows.where(few), n),
    }
    out = [c.select(F.lit(name).alias("extract"), "records", "skipped", "reason", "accepted") for name, c in checks.items()]
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]


@query("normalized_submissions", """
SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS company_name, 'www.h' || c_custkey || '.example.com' AS domain, CASE c_custkey % 2 WHEN 0 THEN 'DE' ELSE 'US' END AS country_iso,
       'ann@h' || c_custkey || '.example' AS email, CASE WHEN c_custkey % 4 > 0 THEN c_address END AS billing_address, CASE WHEN c_custkey % 5 > 0 THEN 'T' || c_custkey END AS tax_id FROM (SELECT *, c_mktsegment || ' 7' AS c_address FROM customer)""")
def normalized_submissions(spark, sf_dir):
    k = F.col("c_custkey")
    text, address = k.cast("string"), F.concat("c_mktsegment", F.lit(" 7"))
    padded = lambda keep, value: F.when(keep, F.concat(F.lit(" "), value, F.lit("  "))).otherwise("  ")
    raw = table(spark, sf_dir, "customer").select(
        k.alias("run_id"), k.alias("submission_id"), padded(k % 3 > 0, F.col("c_name")).alias("company_name"), F.concat(F.lit("HTTPS://www.H"), text, F.lit(".example.com:8080/about?x#y")).alias("company_domain"),
        F.when(k % 2 == 0, "Germany").otherwise("US").alias("country"), F.concat(F.lit(" Ann@H"), text, F.lit(".Example ")).alias("work_email"), padded(k % 4 > 0, address).alias("billing_address"),
        padded(k % 5 > 0, F.concat(F.lit("T"), text)).alias("tax_id"), *(F.lit(None).cast("string").alias(c) for c in ("linkedin_url", "requester_full_name", "source_ip")))
    return intake.normalize_submissions(raw).select("run_id", "company_name", "domain", "country_iso", "email", "billing_address", "tax_id")


@query("numbered_lists", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE p_name || '|' || p_brand END AS parts FROM part""")
def numbered_lists(spark, sf_dir):
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" "), "p_name")).otherwise(F.concat(F.lit("(1) "), "p_name", F.lit(" (2) "), "p_brand", F.lit(" (3) ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(numbered(value), "|").alias("parts"))


@query("repeated_intake", """
SELECT o_custkey AS idempotency_key, 's' || o_custkey AS submission_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders WHERE o_custkey % 10 = 0 GROUP BY o_custkey""")
def repeated_intake(spark, sf_dir):
    """A repeated key gets the stored submission and its newest run."""
    c, key = table(spark, sf_dir, "customer"), F.col("o_custkey")
    submission = lambda k: F.concat(F.lit("s"), k.cast("string"))
    stored = c.select(F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey")).alias("idempotency_key"), submission(F.col("c_custkey")).alias("submission_id"))
    o = table(spark, sf_dir, "orders")
    runs = o.select(submission(key).alias("submission_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return intake.existing_runs(o.select(key.alias("idempotency_key")), stored, runs)
