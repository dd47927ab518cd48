"""Registered queries: intake, privacy, encryption, evaluation and list-entry parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewatch.functions import text
from sievewatch.operators import crypto, evaluate, lists, privacy
from sievewatch.plans import scoring
from sievewatch.plans.base import AS_OF, query, table
from sievewatch.plans.inputs import subjects
from sievewatch.sources import evidence as producers
from sievewatch.sources import intake
from sievewatch.sources.lists import parse_ofac
from sievewatch.sources.sinks import vanished_keys


@query("truncated_addresses", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10.' || (user_id % 256) || '.' || (event_id % 256) || '.0/24' WHEN 1 THEN '2001:db8:' || printf('%x', user_id % 65536 + 1) || '::/48' END AS network FROM events""")
def truncated_addresses(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id")
    v4 = F.concat_ws(".", F.lit("10"), (u % 256).cast("string"), (k % 256).cast("string"), F.lit("77"))
    v6 = F.concat(F.lit("2001:0DB8:"), F.lower(F.hex(u % 65536 + 1)), F.lit("::"), F.lower(F.hex(k % 65536)))
    ip = F.when(k % 3 == 0, v4).when(k % 3 == 1, v6).otherwise(F.concat(v4, F.lit(".9")))
    return table(spark, sf_dir, "events").select("event_id", text.truncate_ip(ip).alias("network"))


def _submissions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("submission_id"), F.when(k % 4 != 0, F.concat_ws(".", F.lit("10.1"), (k % 256).cast("string"), F.lit("9"))).alias("source_ip"),
        F.when(k % 3 == 0, "agent").alias("user_agent"), F.lit(None).cast("string").alias("forwarded_headers"), F.col("o_orderdate").alias("submitted_at"),
        F.when(k % 9 == 0, privacy.ANONYMIZED_EMAIL).otherwise("a@b.example").alias("work_email"), F.lit("12-3").alias("tax_id"), F.lit("x").alias("billing_address"),
        F.lit("1").alias("phone"), F.lit("A B").alias("requester_full_name"), F.lit("u").alias("linkedin_url"), F.lit("[]").alias("declared_people"), F.lit("Harbor").alias("company_name"))


@query("network_anonymization", """
SELECT o_orderkey AS submission_id, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN due THEN '10.1.' || (o_orderkey % 256) || '.0/24' ELSE '10.1.' || (o_orderkey % 256) || '.9' END END AS source_ip,
  CASE WHEN o_orderkey % 3 = 0 AND NOT due THEN 'agent' END AS user_agent, due AS network_anonymized
FROM (SELECT *, o_orderdate <= TIMESTAMP '2000-06-01' - INTERVAL 90 DAY AND (o_orderkey % 4 <> 0 OR o_orderkey % 3 = 0) AS due FROM orders)""")
def network_anonymization(spark, sf_dir):
    return privacy.anonymize_network(_submissions(spark, sf_dir), "2000-06-01 00:00:00").select("submission_id", "source_ip", "user_agent", "network_anonymized")


def _due(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    runs = li.select(F.col("l_orderkey").alias("submission_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("run_id")).distinct()
    reviews = li.filter("l_quantity > 25").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("run_id"), F.when(F.col("l_quantity") > 30, F.col("l_shipdate")).alias("decided_at"))
    return privacy.retention_due(_submissions(spark, sf_dir), reviews, runs, "2002-01-01 00:00:00")


_DUE_SQL = """
r AS (SELECT l_orderkey AS id, max(l_shipdate) AS t FROM lineitem WHERE l_quantity > 30 GROUP BY ALL),
d AS (SELECT o_orderkey AS submission_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN t <= TIMESTAMP '2002-01-01' - INTERVAL 1825 DAY THEN 'reviewed'
  WHEN t IS NULL AND o_orderdate <= TIMESTAMP '2002-01-01' - INTERVAL 180 DAY THEN 'unreviewed' END AS due, o_orderkey FROM orders LEFT JOIN r ON id = o_orderkey)"""


@query("retention_due", f"WITH {_DUE_SQL} SELECT submission_id, due, CASE WHEN due IS NOT NULL OR o_orderkey % 9 = 0 THEN 'redacted@anonymized.invalid' ELSE 'a@b.example' END AS work_email, CASE WHEN due IS NULL THEN '12-3' END AS tax_id FROM d")
def retention_due(spark, sf_dir):
    return privacy.anonymize_pii(_due(spark, sf_dir)).select("submission_id", "due", "work_email", "tax_id")


@query("anonymized_submissions", f"WITH {_DUE_SQL} SELECT submission_id FROM d WHERE due IS NOT NULL OR o_orderkey % 9 = 0")
def anonymized_submissions(spark, sf_dir):
    return privacy.anonymized_submissions(_submissions(spark, sf_dir), _due(spark, sf_dir))


@query("retention_counts", f"""WITH {_DUE_SQL}, {scoring.EVIDENCE_SQL.strip()}
SELECT 'network_metadata' AS category, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '2002-01-01' - INTERVAL 90 DAY AND (o_orderkey % 4 <> 0 OR o_orderkey % 3 = 0)
UNION ALL SELECT due || '_pii', count(*) FROM d WHERE due IS NOT NULL GROUP BY due
UNION ALL SELECT 'requester_association', count(*) FROM ev JOIN d ON run_id = submission_id WHERE contains(payload, 'associated_people') AND (due IS NOT NULL OR o_orderkey % 9 = 0)""")
def retention_counts(spark, sf_dir):
    subs, due = _submissions(spark, sf_dir), _due(spark, sf_dir)
    runs = subs.select(F.col("submission_id").alias("run_id"), "submission_id")
    scrubbed = privacy.scrub_evidence(scoring.evidence(spark, sf_dir), runs, privacy.anonymized_submissions(subs, due))
    return privacy.retention_counts(subs, due, scrubbed, AS_OF)


@query("redacted_for_system", f"""WITH {scoring.EVIDENCE_SQL.strip()}
SELECT evidence_id, CASE WHEN source = 'public_records' THEN CASE WHEN contains(payload, 'Individual') THEN '[redacted]' ELSE 'Harbor' END END AS party_name
FROM ev WHERE source <> 'ipinfo' AND field <> 'linkedin_requester_match'""")
def redacted_for_system(spark, sf_dir):
    out = privacy.redact_evidence(scoring.evidence(spark, sf_dir), "system")
    return out.select("evidence_id", F.get_json_object("raw_payload", "$.party_name").alias("party_name"))


@query("redacted_for_operator", f"WITH {scoring.EVIDENCE_SQL.strip()} SELECT evidence_id, CASE WHEN source <> 'ipinfo' THEN 'https://host/ip' END AS source_url FROM ev")
def redacted_for_operator(spark, sf_dir):
    out = privacy.redact_evidence(scoring.evidence(spark, sf_dir), "operator")
    return out.select("evidence_id", F.get_json_object("attribution", "$.source_url").alias("source_url"))


@query("pii_flags", f"""WITH {scoring.EVIDENCE_SQL.strip()}, a AS (
 SELECT run_id, source = 'ipinfo' OR field = 'linkedin_requester_match' OR contains(payload, 'Individual') AS p FROM ev
 UNION ALL SELECT o_orderkey, f = 'billing_address' FROM (SELECT o_orderkey, unnest(['company_name', 'country_iso', 'billing_address', 'linkedin_website']) AS f, unnest([0, 1, 2, 3]) AS n FROM orders WHERE o_orderkey % 4 <> 0)
   WHERE (o_orderkey // 4 + n) % 3 = 1)
SELECT run_id, bool_or(p) AS has_pii FROM a GROUP BY run_id""")
def pii_flags(spark, sf_dir):
    return privacy.pii_flags(scoring.evidence(spark, sf_dir), scoring.comparisons(spark, sf_dir))


_MASTER = {"m1": bytes(range(32))}


@query("encryption_round_trip", "SELECT c_custkey AS subject_id, c_name AS plain, c_custkey % 7 = 0 AS shredded FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, NULL, true FROM customer WHERE c_custkey % 7 = 0")
def encryption_round_trip(spark, sf_dir):
    masters = crypto.master_keys(spark, _MASTER)
    subs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_name").alias("pii_blob"))
    # Random keys are drawn once and written before anything is sealed with them.
    keys = crypto.new_subject_keys(subs, None, masters, "m1")
    from sievewatch.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    keys = keys.checkpoint()
    sealed = crypto.encrypt(subs, keys, masters, "pii_blob", "pii", "pii_blob").checkpoint()
    live = sealed.withColumns({"shredded_at": F.lit(None).cast("timestamp"),
                               "relationship_ended_at": F.when(F.col("subject_id") % 7 == 0, F.lit("1996-01-01").cast("timestamp"))})
    _subs, kept = crypto.shred(live, keys, AS_OF)
    return crypto.decrypt(sealed, kept, masters, "pii_blob", "pii").select("subject_id", "plain", "shredded")


@query("intake_validation", """
SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'company_name' WHEN o_orderkey % 7 = 0 THEN 'work_email' WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 'people' ELSE 'accepted' END AS outcome, count(*) AS n FROM orders GROUP BY ALL""")
def intake_validation(spark, sf_dir):
    good, bad = intake.validate_submissions(_intake(spark, sf_dir))
    return good.select(F.lit("accepted").alias("outcome")).union(bad.select(F.element_at("reject_reasons", 1))).groupBy("outcome").agg(F.count("*").alias("n"))


def _intake(spark, sf_dir):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    person = F.struct(F.lit(" Ada  Byron").alias("name"), F.when(k % 5 == 0, F.when(k % 2 == 0, "friend").otherwise("owner")).otherwise("officer").alias("relationship"), none.alias("role"),
                      F.lit("1970-02").alias("dob"), none.alias("nationality"), F.lit(10.0).alias("ownership_pct"))
    return table(spark, sf_dir, "orders").select(
        k.alias("submission_id"), F.when(k % 11 == 0, " ").otherwise("Harbor").alias("company_name"), F.when(k % 7 == 0, "not-an-address").otherwise("a@b.example").alias("work_email"),
        F.lit("HTTPS://Harbor.example/x").alias("company_domain"), F.lit("US").alias("country"), none.alias("tax_id"), F.lit("R1").alias("registration_number"), none.alias("billing_address"),
        none.alias("linkedin_url"), F.array(person).alias("people"), F.when(k % 3 != 0, F.col("o_custkey")).alias("idempotency_key"), F.col("o_orderdate").alias("submitted_at"))


@query("screening_intake_validation", """
SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'name' WHEN o_orderkey % 6 = 0 THEN 'documents' WHEN o_orderkey % 5 = 0 THEN 'dob' ELSE 'accepted' END AS outcome, count(*) AS n FROM orders GROUP BY ALL""")
def screening_intake_validation(spark, sf_dir):
    k = F.col("o_orderkey")
    doc = F.struct(F.when(k % 6 == 0, "library_card").otherwise("passport").alias("type"), F.lit("1").alias("number"), F.lit("US").alias("country"))
    raw = table(spark, sf_dir, "orders").select(
        k.alias("subject_id"), F.when(k % 13 == 0, "  ").otherwise("Ada").alias("name"), F.array(F.lit("A")).alias("aliases"), F.when(k % 5 == 0, "1970-13").otherwise("1970-12").alias("dob"), F.array(doc).alias("documents"))
    good, bad = intake.validate_screenings(raw)
    return good.select(F.lit("accepted").alias("outcome")).union(bad.select(F.element_at("reject_reasons", 1))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("idempotent_intake", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey AS submission_id FROM k WHERE n = 1 AND o_custkey % 10 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0""")
def idempotent_intake(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("idempotency_key"))
    return intake.dedupe_intake(_intake(spark, sf_dir), stored).select("submission_id")


@query("corrections_overlay", """
SELECT c_custkey AS submission_id, CASE WHEN c_custkey % 4 = 0 THEN 'Fixed ' || c_custkey ELSE c_name END AS company_name, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_mktsegment END AS country,
  CASE WHEN c_custkey % 12 = 0 THEN 2 WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS n_changed FROM customer""")
def corrections_overlay(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    subs = c.select(k.alias("submission_id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("country"))
    name = F.create_map(F.lit("company_name"), F.concat(F.lit("Fixed "), k.cast("string")))
    fixes = c.filter(k % 4 == 0).select(k.alias("submission_id"), F.when(k % 12 == 0, F.map_concat(name, F.create_map(F.lit("country"), F.lit(None).cast("string")))).otherwise(name).alias("fields"))
    fixed, changed = intake.apply_corrections(subs, fixes)
    n = changed.groupBy("submission_id").agg(F.count("*").alias("n"))
    return fixed.join(n, "submission_id", "left").select("submission_id", "company_name", "country", F.coalesce("n", F.lit(0)).alias("n_changed"))


@query("source_availability", """
SELECT user_id AS run_id, string_agg(event_type || '=' || CASE WHEN up THEN 'available' ELSE 'unavailable' END, ',' ORDER BY event_type) AS status
FROM (SELECT user_id, event_type, bool_or(event_id % 5 < 2) AS up FROM events GROUP BY ALL) GROUP BY user_id""")
def source_availability(spark, sf_dir):
    k = F.col("event_id")
    tries = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("source"), F.element_at(F.array(
        F.lit("success"), F.lit("not_found"), F.lit("timeout"), F.lit("unavailable"), F.lit("rate_limited")), (k % 5 + 1).cast("int")).alias("outcome"))
    m = producers.source_status(tries)
    pairs = F.transform(F.array_sort(F.map_entries("source_availability")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("run_id", F.array_join(pairs, ",").alias("status"))


@query("list_entry_remarks", """
SELECT p_partkey AS id, 'Ann BLOCK' || p_partkey AS primary_name, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END AS n_names,
  CASE p_partkey % 4 WHEN 0 THEN printf('19%02d-03-%02d', p_partkey % 80 + 10, p_partkey % 28 + 1) WHEN 1 THEN '~19' || (p_partkey % 80 + 10) WHEN 2 THEN '19' || (p_partkey % 80 + 10) || '-2000' ELSE '' END AS dob,
  CASE WHEN p_partkey % 2 = 0 THEN 'Russia|Iran' ELSE 'Russia' END AS nationalities, 'P' || p_partkey || '/Iran' AS passport, CASE WHEN p_partkey % 5 = 0 THEN 'Male' END AS gender FROM part WHERE p_partkey % 6 <> 5""")
def list_entry_remarks(spark, sf_dir):
    k = F.col("p_partkey")
    s = k.cast("string")
    yy = (k % 80 + 10).cast("string")
    dob = F.when(k % 4 == 0, F.concat(F.lit("DOB "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" Mar 19"), yy)).when(k % 4 == 1, F.concat(F.lit("DOB circa 19"), yy)).when(
        k % 4 == 2, F.concat(F.lit("alt. DOB 19"), yy, F.lit(" to 2000"))).otherwise("DOB unknown")
    remarks = F.concat_ws("; ", dob, F.lit("nationality Russia"), F.when(k % 2 == 0, "alt. citizen Iran"), F.concat(F.lit("Passport P"), s, F.lit(" (Iran)")),
                          F.when(k % 3 == 0, "a.k.a. 'OTHER, Name'"), F.when(k % 5 == 0, "Gender Male."))
    entries = table(spark, sf_dir, "part").select(s.alias("id"), F.concat(F.lit("BLOCK"), s, F.lit(", Ann")).alias("name"), F.when(k % 6 == 5, "vessel").otherwise("individual").alias("sdn_type"),
                                                  F.lit("X").alias("program"), remarks.alias("remarks"))
    d = F.try_element_at("dobs", F.lit(1))
    shown = F.coalesce(d["date"], F.when(d["circa"], F.concat(F.lit("~"), d["year"].cast("string"))), F.concat_ws("-", d["from_year"].cast("string"), d["to_year"].cast("string")))
    doc = F.element_at("documents", 1)
    return parse_ofac(entries).select(F.col("source_entry_id").cast("long").alias("id"), "primary_name", F.size("names").alias("n_names"), F.coalesce(shown, F.lit("")).alias("dob"),
                                      F.array_join("nationalities", "|").alias("nationalities"), F.concat(doc["number"], F.lit("/"), doc["country"]).alias("passport"), "gender")


def _labelled(spark, sf_dir):
    """Labelled documents as cases: a good document should find itself; long documents are candidates."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    cases = lab.join(d.select("doc_id", "lang", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("subject_id"), F.col("lang").alias("category"), F.when(F.col("quality") == 1, F.array("doc_id")).otherwise(F.array().cast("array<bigint>")).alias("expected_hits"))
    watch = d.select(F.col("doc_id").alias("record_id"), "n_chars", "lang")
    return cases, watch


@query("matcher_evaluation", """
WITH c AS (SELECT doc_id, quality FROM labels JOIN documents USING (doc_id)), p AS (SELECT c.doc_id AS s, d.doc_id AS r, d.n_chars AS score FROM c JOIN documents d ON d.doc_id IN (c.doc_id, c.doc_id + 1)),
t AS (SELECT min(score) AS m FROM p JOIN c ON c.doc_id = s WHERE quality = 1 AND s = r), o AS (SELECT score FROM p JOIN c ON c.doc_id = s WHERE NOT (quality = 1 AND s = r))
SELECT (SELECT count(*) FROM c) AS cases, 1.0::DOUBLE AS blocking_recall, round((SELECT count(*) FROM p)::DOUBLE / (SELECT count(*) FROM c), 3) AS candidates_per_case, m AS threshold_at_full_recall,
  round((SELECT count(*) FILTER (WHERE score >= m)::DOUBLE / count(*) FROM o), 6) AS fp_rate_at_full_recall FROM t""")
def matcher_evaluation(spark, sf_dir):
    cases, watch = _labelled(spark, sf_dir)

    def blocker(c, w):
        near = c.select("subject_id", F.explode(F.array(F.col("subject_id"), F.col("subject_id") + 1)).alias("record_id"))
        return near.join(w.select("record_id"), "record_id", "left_semi")

    def scorer(pairs, _c, w):
        return pairs.join(w.select("record_id", F.col("n_chars").alias("score")), "record_id")

    return evaluate.evaluate(cases, watch, blocker, scorer).withColumn("fp_rate_at_full_recall", F.round("fp_rate_at_full_recall", 6))


@query("blocking_misses", "SELECT doc_id AS subject_id, doc_id AS record_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND n_chars < 500")
def blocking_misses(spark, sf_dir):
    cases, watch = _labelled(spark, sf_dir)
    found = watch.filter("n_chars >= 500").select(F.col("record_id").alias("subject_id"), "record_id")
    return evaluate.missed_pairs(cases, found)


def _decisions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    b = F.col("c_acctbal")
    d = F.when(b > 8000, "MATCH").when(b > 2000, "REVIEW").otherwise("CLEAR")
    status = F.create_map(F.lit("list:a"), F.when(F.col("c_custkey") % 10 == 0, "unavailable").otherwise("complete"))
    cases = c.select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("category"))
    return cases, c.select(F.col("c_custkey").alias("subject_id"), F.col("c_custkey").alias("decision_id"), d.alias("disposition"), (d == "CLEAR").alias("auto_closed"), status.alias("source_status"))


@query("disposition_metrics", """
SELECT coalesce(c_mktsegment, '(all)') AS category, count(*) AS cases, count(*) FILTER (WHERE c_acctbal <= 2000) AS clear, count(*) FILTER (WHERE c_acctbal > 2000 AND c_acctbal <= 8000) AS review,
  count(*) FILTER (WHERE c_acctbal > 8000) AS match, round(count(*) FILTER (WHERE c_acctbal > 2000 AND c_acctbal <= 8000)::DOUBLE / count(*), 4) AS abstention_rate,
  round(count(*) FILTER (WHERE c_custkey % 10 <> 0)::DOUBLE / count(*), 4) AS coverage, round(count(*) FILTER (WHERE c_custkey % 50 <> 0)::DOUBLE / count(*), 4) AS reproducibility
FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def disposition_metrics(spark, sf_dir):
    cases, decisions = _decisions(spark, sf_dir)
    again = decisions.withColumn("auto_closed", F.when(F.col("subject_id") % 50 == 0, ~F.col("auto_closed")).otherwise(F.col("auto_closed")))
    return evaluate.disposition_metrics(cases, decisions, again)


@query("metric_gates", """SELECT 'reproducibility' AS metric, value, 1.0::DOUBLE AS target FROM (SELECT round(count(*) FILTER (WHERE c_custkey % 50 <> 0)::DOUBLE / count(*), 4) AS value FROM customer) WHERE value < 1""")
def metric_gates(spark, sf_dir):
    return evaluate.gate(disposition_metrics(spark, sf_dir).filter("category = '(all)'"))


@query("category_pivot", """
SELECT c_mktsegment AS category, count(*) FILTER (WHERE c_acctbal <= 2000) AS CLEAR, count(*) FILTER (WHERE c_acctbal > 2000 AND c_acctbal <= 8000) AS REVIEW, count(*) FILTER (WHERE c_acctbal > 8000) AS MATCH FROM customer GROUP BY ALL""")
def category_pivot(spark, sf_dir):
    return evaluate.category_pivot(*_decisions(spark, sf_dir))


@query("alert_rate", "SELECT count(*) AS screenings, count(*) FILTER (WHERE c_acctbal > 2000) AS alerts, round(count(*) FILTER (WHERE c_acctbal > 2000) * 1000.0 / count(*), 3)::DOUBLE AS alerts_per_1000 FROM customer")
def alert_rate(spark, sf_dir):
    return evaluate.alert_rate(_decisions(spark, sf_dir)[1])


@query("time_to_disposition", """
WITH f AS (SELECT o_orderkey, o_orderdate, min(l_shipdate) AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate GROUP BY ALL),
h AS (SELECT hours, row_number() OVER (ORDER BY hours) AS rn, count(*) OVER () AS n FROM (SELECT epoch_us(first::TIMESTAMP - o_orderdate::TIMESTAMP) / 3600000000.0 AS hours FROM f))
SELECT count(*) AS disposed, min(hours) FILTER (WHERE rn >= 0.5 * n) AS median_hours, min(hours) FILTER (WHERE rn >= 0.95 * n) AS p95_hours FROM h""")
def time_to_disposition(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    decided = o.select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderdate").alias("decided_at"))
    later = li.select(F.col("l_orderkey").alias("decision_id"), F.col("l_shipdate").alias("created_at")).join(decided, "decision_id").filter("created_at >= decided_at")
    return evaluate.time_to_disposition(decided, later.drop("decided_at"))


@query("append_only_check", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 100 = 17")
def append_only_check(spark, sf_dir):
    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return vanished_keys(before, before.filter("key % 100 <> 17"), ["key"])


@query("truncated_columns", "SELECT doc_id, substr(text, 1, 40) AS text, (length(text) > 40)::INT AS n_truncated FROM documents")
def truncated_columns(spark, sf_dir):
    return lists.truncate_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": 40}).select("doc_id", "text", "n_truncated")


@query("subjects_by_country", """
SELECT n, count(*) AS subjects FROM (SELECT (['US','GB','DE','FR','RU','IR','KP','SY','CN','BR'])[c_nationkey % 10 + 1] AS n FROM customer) GROUP BY n""")
def subjects_by_country(spark, sf_dir):
    from sievewatch.functions.register import register_functions

    register_functions(spark)
    subjects(spark, sf_dir).createOrReplaceTempView("sievewatch_subjects")
    return spark.sql("SELECT iso2(nationality) AS n, count(*) AS subjects FROM sievewatch_subjects GROUP BY 1")
