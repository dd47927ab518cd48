"""Registered queries: officers and owners, monitoring reasons, citations, dockets, list steps, audit rows and page cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewatch.operators import explain, lists, monitor, people, public_records, queue
from sievewatch.plans.base import AS_OF, parts_by_rows, pick, query, sql_pick, table
from sievewatch.plans.listing import _RUNS_SQL, _runs
from sievewatch.sources import evidence as producers

RELATIONS = ("owner", "officer")
CHANGES = ("added", "changed", "removed")


def _linked(spark, sf_dir):
    """Every order as a person linked to a subject of a company."""
    k = F.col("o_orderkey")
    one = F.struct(F.lit("declared").alias("source"), F.lit(None).cast("string").alias("provider"), F.concat(F.lit("form:"), k.cast("string")).alias("locator"))
    return table(spark, sf_dir, "orders").select(
        k.alias("run_id"), F.concat(F.lit("p"), k.cast("string")).alias("person_id"), (F.col("o_custkey") % 40).alias("entity_id"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 77).cast("string")).alias("subject_id"),
        F.when(k % 3 == 0, F.array(*map(F.lit, RELATIONS))).when(k % 3 == 1, F.array(F.lit("officer"))).otherwise(F.array(F.lit("owner"))).alias("relationships"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("role "), (k % 4).cast("string")))).alias("roles"),
        F.array(one).alias("sources"), (k % 100).cast("double").alias("ownership_pct"))


@query("company_links", """
WITH l AS (SELECT o_orderkey AS k, o_custkey % 40 AS entity_id, 's' || (o_custkey % 77) AS subject_id,
             unnest(CASE o_orderkey % 3 WHEN 0 THEN ['owner', 'officer'] WHEN 1 THEN ['officer'] ELSE ['owner'] END) AS relationship FROM orders),
n AS (SELECT entity_id, subject_id, relationship, max(k) AS k FROM l GROUP BY ALL),
o AS (SELECT s_suppkey % 40 AS entity_id, 's' || (s_suppkey % 77) AS subject_id, 'owner' AS relationship, -min(s_suppkey) AS first_run FROM supplier GROUP BY ALL)
SELECT entity_id, subject_id, relationship, coalesce(first_run, k) AS first_run_id,
       CASE WHEN k IS NULL OR k % 4 = 0 THEN CASE WHEN first_run IS NOT NULL THEN 'before' END ELSE 'role ' || (k % 4) END AS role,
       CASE WHEN k IS NULL THEN 'stored' ELSE '[{"source":"declared","locator":"form:' || k || '"}]' END AS sources,
       CASE WHEN relationship = 'owner' THEN coalesce((k % 100)::DOUBLE, 1.5) END AS ownership_pct
FROM n FULL JOIN o USING (entity_id, subject_id, relationship)""")
def company_links(spark, sf_dir):
    s = F.col("s_suppkey")
    stored = table(spark, sf_dir, "supplier").groupBy((s % 40).alias("entity_id"), F.concat(F.lit("s"), (s % 77).cast("string")).alias("subject_id")).agg((-F.min(s)).alias("first_run_id"))
    stored = stored.select("*", F.lit("owner").alias("relationship"), F.lit("before").alias("role"), F.lit("stored").alias("sources"), F.lit(1.5).alias("ownership_pct"))
    return people.company_links(_linked(spark, sf_dir), stored)


@query("officer_panel", """
SELECT o_orderkey AS run_id, 's' || (o_custkey % 77) AS subject_id, CASE WHEN o_custkey % 77 % 5 = 0 THEN 'unavailable' WHEN o_custkey % 77 % 2 = 0 THEN 'REVIEW' ELSE 'CLEAR' END AS system_disposition,
       CASE o_orderkey % 3 WHEN 0 THEN 'owner,officer' WHEN 1 THEN 'officer' ELSE 'owner' END AS relationships, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'role ' || (o_orderkey % 4) END AS roles,
       (o_orderkey % 100)::DOUBLE AS ownership_pct, CASE WHEN o_custkey % 77 % 5 <> 0 THEN (o_custkey % 77) / 100 END AS top_score,
       CASE WHEN s.k IS NOT NULL THEN s.k % 7 = 0 END AS shredded, h.disposition AS human_disposition
FROM orders LEFT JOIN (SELECT DISTINCT c_custkey % 77 AS k FROM customer WHERE c_custkey % 77 <> 3) s ON s.k = o_custkey % 77
LEFT JOIN (SELECT p_partkey % 77 AS k, CASE arg_max(p_partkey, (p_size, -p_partkey)) % 2 WHEN 0 THEN 'MATCH' ELSE 'CLEAR' END AS disposition FROM part WHERE p_partkey % 77 < 60 GROUP BY 1) h ON h.k = o_custkey % 77""")
def officer_panel(spark, sf_dir):
    """Officers linked to subjects, their results as evidence, and the panel that reads it back."""
    c, p = F.col("c_custkey") % 77, F.col("p_partkey")
    name = lambda k: F.concat(F.lit("s"), k.cast("string"))
    who = table(spark, sf_dir, "customer").select(c.alias("k")).distinct()
    decisions = who.where("k % 5 <> 0").select(name(F.col("k")).alias("subject_id"), F.when(F.col("k") % 2 == 0, "REVIEW").otherwise("CLEAR").alias("disposition"),
                                               (F.col("k") % 2 == 1).alias("auto_closed"), (F.col("k") / 100).alias("top_score"))
    every = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 77).alias("k")).distinct()
    decisions = decisions.unionByName(every.join(who, "k", "left_anti").where("k % 5 <> 0").select(
        name(F.col("k")).alias("subject_id"), F.when(F.col("k") % 2 == 0, "REVIEW").otherwise("CLEAR").alias("disposition"), (F.col("k") % 2 == 1).alias("auto_closed"), (F.col("k") / 100).alias("top_score")))
    subjects = who.where("k <> 3").select(name(F.col("k")).alias("subject_id"), F.when(F.col("k") % 7 == 0, F.lit(AS_OF).cast("timestamp")).alias("shredded_at"))
    human = table(spark, sf_dir, "part").where(p % 77 < 60).select(
        name(p % 77).alias("subject_id"), p.alias("disposition_id"), F.timestamp_seconds(F.col("p_size")).alias("created_at"), F.when(p % 2 == 0, "MATCH").otherwise("CLEAR").alias("disposition"))
    evidence = people.officer_evidence(_linked(spark, sf_dir), decisions, AS_OF)
    panel = people.officer_panel(evidence, subjects, human)
    return panel.withColumns({"relationships": F.array_join("relationships", ","), "roles": F.array_join("roles", ",")})


@query("monitoring_reasons", f"""
WITH r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey - 1 END AS prior_run_id FROM orders WHERE o_orderkey % 3 = 0),
h AS (SELECT DISTINCT l_orderkey AS run_id, l_suppkey::VARCHAR AS changed_entry_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE {sql_pick(CHANGES, 's_suppkey % 3')} <> 'removed')
SELECT run_id, 'snap-9' AS snapshot_id, changed_entry_id, prior_run_id, CASE WHEN p.o_orderkey IS NOT NULL THEN p.o_orderstatus END AS prior_disposition
FROM r LEFT JOIN h USING (run_id) LEFT JOIN orders p ON p.o_orderkey = prior_run_id""")
def monitoring_reasons(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    o = table(spark, sf_dir, "orders")
    runs = o.select(k.alias("run_id"), F.when(k % 3 == 0, "monitoring").otherwise("intake").alias("trigger"), F.lit("snap-9").alias("snapshot_id"), F.when(k % 2 == 0, k - 1).alias("prior_run_id"))
    cands = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").cast("string").alias("source_entry_id"))
    delta = table(spark, sf_dir, "supplier").select(s.cast("string").alias("source_entry_id"), pick(CHANGES, s % 3).alias("change"))
    return monitor.monitoring_reason(runs, cands, delta, o.select(k.alias("run_id"), F.col("o_orderstatus").alias("disposition")))


@query("citations", f"""
SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Sanctions list' ELSE 'subject_submission' END AS display_name, CASE WHEN o_orderkey % 2 = 0 THEN 'E:' || o_custkey END AS entry_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'names' ELSE 'dob' END AS field, CASE WHEN o_orderkey % 2 = 0 THEN 'snap-' || (o_orderkey % 7) END AS snapshot_id,
       CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 < 5 THEN 'sha-' || (o_orderkey % 7) END AS content_sha256 FROM orders""")
def citations(spark, sf_dir):
    k = F.col("o_orderkey")
    record = k % 2 == 0
    locator = F.when(record, F.concat(F.lit("ofac_sdn:E:"), F.col("o_custkey").cast("string"), F.lit("@snap-"), (k % 7).cast("string"), F.lit("#names"))).otherwise(
        F.concat(F.lit("screening_subject:"), F.col("o_custkey").cast("string"), F.lit("#dob")))
    claims = table(spark, sf_dir, "orders").select(
        k.alias("claim_id"), F.when(record, "record").otherwise("subject").alias("about"), F.when(record, "ofac_sdn").otherwise("subject_submission").alias("source"),
        F.lit("field of the claim").alias("field"), locator.alias("locator"), F.lit(AS_OF).cast("timestamp").alias("retrieved_at"))
    snaps = table(spark, sf_dir, "region").select(
        F.concat(F.lit("snap-"), F.col("r_regionkey").cast("string")).alias("snapshot_id"), F.lit(AS_OF).cast("timestamp").alias("retrieved_at"),
        F.concat(F.lit("sha-"), F.col("r_regionkey").cast("string")).alias("content_sha256"))
    return explain.citations(claims, snaps, {"ofac_sdn": "Sanctions list"}).select("claim_id", "display_name", "entry_id", "field", "snapshot_id", "content_sha256")


@query("docket_totals", """
SELECT o_orderkey AS run_id, 'bankruptcy' AS kind, (o_orderkey % 5)::INTEGER AS total, (o_orderkey % 3 = 0)::BIGINT AS stored,
       o_orderkey % 5 > CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS truncated FROM orders""")
def docket_totals(spark, sf_dir):
    """Landed search pages with a docket that is repeated and one without a number."""
    k = F.col("o_orderkey")
    hit = lambda number, at: F.struct(F.lit("deb").alias("court_id"), number.alias("docketNumber"), F.lit(at).alias("docket_id"))
    body = F.to_json(F.struct((k % 5).cast("int").alias("count"), F.array(hit(F.concat(F.lit("n"), (k % 2).cast("string")), 1), hit(F.lit("n0"), 2), hit(F.lit(""), 3)).alias("results")))
    o = table(spark, sf_dir, "orders")
    found, totals = public_records.read_dockets(o.select(k.alias("run_id"), F.lit("bankruptcy").alias("kind"), body.alias("body")))
    stored = o.where(k % 3 == 0).select(k.alias("run_id"), F.lit("bankruptcy").alias("kind"))
    return public_records.docket_summary(totals, found, stored, stored.limit(0))


@query("newest_dockets", """
SELECT run_id, pos FROM (SELECT o_custkey AS run_id, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def newest_dockets(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), k.alias("pos"), F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dateFiled"))
    return public_records.newest(rows, "dateFiled", 3).select("run_id", "pos")


@query("list_steps", """
SELECT 'list ' || n_nationkey AS source, n_nationkey < 10 AS required, CASE WHEN n_nationkey < 10 THEN (20 - n_nationkey)::INTEGER END AS position,
       CASE WHEN n_nationkey < 10 AND n_nationkey % 3 = 0 THEN 'unavailable' WHEN n_nationkey % 4 = 1 AND n_nationkey < 10 THEN 'unavailable' ELSE 'complete' END AS status,
       CASE WHEN n_nationkey % 4 <> 1 THEN 'snap ' || n_nationkey END AS snapshot_id FROM nation WHERE n_nationkey < 10 OR n_nationkey % 4 <> 1""")
def list_steps(spark, sf_dir):
    n = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").withColumn("source", F.concat(F.lit("list "), n.cast("string")))
    current = nation.where(n % 4 != 1).select("source", F.concat(F.lit("snap "), n.cast("string")).alias("snapshot_id"), F.lit(AS_OF).cast("timestamp").alias("retrieved_at"),
                                              F.lit("sha").alias("content_sha256"), n.alias("record_count"))
    required = nation.where(n < 10).select("source", (20 - n).cast("int").alias("position"))
    coverage = nation.where((n < 10) & (n % 3 == 0)).select("source", F.lit("unavailable").alias("status"))
    return lists.list_steps(current, coverage, required).select("source", "required", "position", "status", "snapshot_id")


@query("audit_rows", f"""
SELECT sha256('run.decided|{AS_OF}|' || o_orderkey) AS event_id, 'run.decided' AS event_type, '{{"run_id":' || o_orderkey || ',"n_candidates":' || (o_custkey % 9) || '}}' AS payload FROM orders""")
def audit_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 9).alias("n_candidates"), F.lit("a name").alias("name"))
    return queue.audit_event(rows, "run.decided", ["run_id", "n_candidates"], AS_OF, ["run_id"]).select("event_id", "event_type", "payload")


@query("appended_dispositions", """
SELECT l_orderkey AS decision_id, l_linenumber AS disposition_id, CASE WHEN l_suppkey % 4 > 1 OR l_suppkey % 4 = 0 AND s_suppkey IS NULL THEN 'role' WHEN o_orderkey IS NULL THEN 'no decision' END AS reject_reason, count(*) AS n
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def appended_dispositions(spark, sf_dir):
    """Accepted and rejected human dispositions: operators and leads on decided runs only."""
    s = F.col("s_suppkey")
    human = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("decision_id"), F.col("l_linenumber").alias("disposition_id"), F.col("l_suppkey").alias("operator_id"))
    decided = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("decision_id"))
    roles = table(spark, sf_dir, "supplier").select(s.alias("operator_id"), F.when(s % 4 == 0, "operator").when(s % 4 == 1, "lead").otherwise("viewer").alias("role"))
    parts = parts_by_rows(human)
    taken, refused = queue.append_disposition(human.repartition(parts, "decision_id"), decided, roles)
    both = taken.select("decision_id", "disposition_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(refused.select("decision_id", "disposition_id", "reject_reason"))
    both = both.repartition(parts, "decision_id", "disposition_id")
    return both.groupBy("decision_id", "disposition_id", "reject_reason").agg(F.count("*").alias("n"))


@query("search_terms", r"""
SELECT c_custkey, trim(regexp_replace(regexp_replace('  "' || c_name || '"\ and  "Co"', '["\\]', ' ', 'g'), '\s+', ' ', 'g')) AS phrase,
       CASE WHEN c_custkey % 3 > 0 THEN 'https://www.courtlistener.com/docket/' || (CASE c_custkey % 3 WHEN 1 THEN c_custkey END) || '/' END AS url FROM customer""")
def search_terms(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.concat(F.lit('  "'), F.col("c_name"), F.lit('"\\ and  "Co"'))
    docket = F.when(k % 3 == 1, k.cast("string")).when(k % 3 == 2, "none").otherwise((-k).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", public_records.search_phrase(raw).alias("phrase"), public_records.docket_url(docket).alias("url"))


@query("screening_queue_cursor", f"""WITH {_RUNS_SQL}, q AS (
 SELECT run_id, row_number() OVER (ORDER BY CASE system_disposition WHEN 'MATCH' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'CLEAR' THEN 2 ELSE 3 END, created_at DESC, run_id) AS n
 FROM r LEFT JOIN d USING (run_id))
SELECT run_id, ((n - 1) // 40)::INTEGER AS page FROM q WHERE n <= 120""")
def screening_queue_cursor(spark, sf_dir):
    """Three pages of the queue, each from the last row of the page before."""
    runs, decided, human, _c = _runs(spark, sf_dir)
    pages, after = [], None
    for page in range(3):
        rows = queue.screening_queue(runs, decided, human, limit=40, after=after)
        pages.append(rows.select("run_id", F.lit(page).alias("page")))
        after = queue.last_row(rows, queue.QUEUE_ORDER)
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("audit_log_cursor", "SELECT event_id, ((n - 1) // 70)::INTEGER AS page FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 140")
def audit_log_cursor(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("occurred_at"))
    first = queue.audit_log(events, limit=70)
    second = queue.audit_log(events, limit=70, after=queue.last_row(first, queue.AUDIT_ORDER))
    return first.select("event_id", F.lit(0).alias("page")).unionByName(second.select("event_id", F.lit(1).alias("page")))


@query("first_registry_evidence", """
SELECT o_custkey AS run_id, 'company ' || arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS name, 'street ' || arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderkey % 3 > 0) AS address,
       count(*) AS n_names FROM orders GROUP BY o_custkey""")
def first_registry_evidence(spark, sf_dir):
    """Of several companies in one answer, the first name and the first address are those of the provider's order."""
    k = F.col("o_orderkey")
    company = F.struct(F.concat(F.lit("company "), k.cast("string")).alias("name"), F.when(k % 3 > 0, F.concat(F.lit("street "), k.cast("string"))).alias("registered_address"))
    held = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", k, company.alias("c")))).alias("h"))
    body = F.to_json(F.struct(F.struct(F.transform("h", lambda x: x["c"]).alias("companies")).alias("results")))
    rows = producers.registry_evidence(producers.read_registry(held.select("run_id", body.alias("body"))), AS_OF)
    rows = producers.union_evidence(rows, producers.free_email_evidence(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("a@corp.example").alias("email")), AS_OF))
    order = F.struct("created_at", "evidence_id")
    first = lambda field: F.min_by("raw_value", F.when(F.col("field") == field, order))
    return rows.groupBy("run_id").agg(first("company_name").alias("name"), first("legal_address").alias("address"), F.count_if(F.col("field") == "company_name").alias("n_names"))
