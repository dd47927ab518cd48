"""Registered queries: list snapshots, coverage, monitoring, queues and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewatch.operators import lists, monitor, queue
from sievewatch.plans.base import AS_OF, query, table
from sievewatch.plans.inputs import KEYS_SQL, PEOPLE_SQL, records, subjects, with_ctes

# Two versions of a list: the old one holds orders before 2000 and some later ones, the new one all orders
# but every 13th; every 7th order has another price in the new version.
_OLD = "SELECT o_orderkey AS source_entry_id, o_orderstatus AS names, o_totalprice AS dobs FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' OR o_orderkey % 5 = 0"
_NEW = "SELECT o_orderkey AS source_entry_id, o_orderstatus AS names, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS dobs FROM orders WHERE o_orderkey % 13 <> 0"
_DELTA = f"""SELECT source_entry_id, change FROM (
 SELECT coalesce(o.source_entry_id, n.source_entry_id) AS source_entry_id, CASE WHEN o.source_entry_id IS NULL THEN 'added'
   WHEN n.source_entry_id IS NULL THEN 'removed' WHEN o.names IS DISTINCT FROM n.names OR o.dobs IS DISTINCT FROM n.dobs THEN 'changed' END AS change
 FROM ({_OLD}) o FULL OUTER JOIN ({_NEW}) n ON o.source_entry_id = n.source_entry_id) WHERE change IS NOT NULL"""


def _versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.select(F.col("o_orderkey").alias("source_entry_id"), F.col("o_orderstatus").alias("names"), F.col("o_totalprice").alias("dobs"), "o_orderdate")
    k = F.col("source_entry_id")
    old = base.filter((F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")) | (k % 5 == 0))
    new = base.filter(k % 13 != 0).withColumn("dobs", F.when(k % 7 == 0, F.col("dobs") + 1).otherwise(F.col("dobs")))
    return old.drop("o_orderdate"), new.drop("o_orderdate")


@query("snapshot_delta", _DELTA)
def snapshot_delta(spark, sf_dir):
    return lists.snapshot_delta(*_versions(spark, sf_dir), compared=("names", "dobs"))


@query("snapshot_delta_counts", f"SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'changed') AS changed, "
       f"count(*) FILTER (WHERE change = 'removed') AS removed FROM ({_DELTA})")
def snapshot_delta_counts(spark, sf_dir):
    return lists.delta_counts(lists.snapshot_delta(*_versions(spark, sf_dir), compared=("names", "dobs")))


# Orders as snapshots of one list per customer.
def _snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("retrieved_at"),
                    F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 100).cast("int").alias("record_count"),
                    F.col("o_orderpriority").alias("content_sha256"))


@query("previous_snapshots", """
WITH m AS (SELECT o_custkey AS source, o_orderdate AS t, min(o_orderkey) AS f FROM orders GROUP BY ALL),
p AS (SELECT source, t, lag(f) OVER (PARTITION BY source ORDER BY t) AS previous_id FROM m)
SELECT o_orderkey AS snapshot_id, previous_id FROM orders JOIN p ON source = o_custkey AND t = o_orderdate""")
def previous_snapshots(spark, sf_dir):
    return lists.with_previous(_snapshots(spark, sf_dir)).select("snapshot_id", "previous_id")


@query("current_snapshots", """
SELECT source, snapshot_id FROM (SELECT o_custkey AS source, o_orderkey AS snapshot_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) WHERE n = 1""")
def current_snapshots(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"))
    return lists.current_snapshots(_snapshots(spark, sf_dir), held).select("source", "snapshot_id")


@query("retained_snapshots", """
SELECT source, snapshot_id FROM (SELECT o_custkey AS source, o_orderkey AS snapshot_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 7""")
def retained_snapshots(spark, sf_dir):
    return lists.retain_newest(_snapshots(spark, sf_dir), 7).select("source", "snapshot_id")


@query("new_list_versions", """
WITH f AS (SELECT source, sha256(text) AS content_sha256, doc_id FROM documents),
s AS (SELECT source, arg_max(sha256(text), doc_id) AS last FROM documents GROUP BY source)
SELECT f.source, doc_id, f.content_sha256 FROM f LEFT JOIN s USING (source) WHERE f.content_sha256 IS DISTINCT FROM last""")
def new_list_versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("retrieved_at"))
    stored = docs.select("source", F.sha2("content", 256).alias("content_sha256"), "retrieved_at")
    fresh = lists.new_snapshots(docs, stored)
    return fresh.select("source", F.col("retrieved_at").alias("doc_id"), "content_sha256")


@query("list_coverage", """
WITH latest AS (SELECT event_type AS source, max(ts) AS t FROM events WHERE event_type <> 'view' AND (event_type <> 'error' OR ts < TIMESTAMP '2024-01-15') GROUP BY ALL),
req(source) AS (VALUES ('error'), ('signup'), ('purchase'), ('view'))
SELECT source, CASE WHEN t IS NOT NULL AND t >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY THEN 'complete' ELSE 'unavailable' END AS status FROM req LEFT JOIN latest USING (source)""")
def list_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter((F.col("event_type") != "view") & ((F.col("event_type") != "error") | (F.col("ts") < "2024-01-15")))
    snaps = e.select(F.col("event_type").alias("source"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("retrieved_at"))
    current = lists.current_snapshots(snaps, snaps)
    required = lists.required_dim(spark, ("error", "signup", "purchase", "view"))
    return lists.list_coverage(current, required, "2024-02-01 00:00:00").select("source", "status")


@query("ingest_guard", """
SELECT count(*) FILTER (WHERE l_quantity > 5) AS records, count(*) FILTER (WHERE l_quantity <= 5) AS skipped,
  CASE WHEN count(*) FILTER (WHERE l_quantity > 5) = 0 THEN 'no usable rows'
       WHEN count(*) FILTER (WHERE l_quantity <= 5) > 5 AND count(*) FILTER (WHERE l_quantity <= 5) > count(*) * 0.05 THEN 'too many unusable rows' END AS reason,
  NOT (count(*) FILTER (WHERE l_quantity <= 5) > 5 AND count(*) FILTER (WHERE l_quantity <= 5) > count(*) * 0.05) AS accepted FROM lineitem""")
def ingest_guard(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity")
    return lists.check_ingest(li.filter("l_quantity > 5"), li.filter("l_quantity <= 5"), None)


@query("monitoring_rescreen", with_ctes(PEOPLE_SQL, KEYS_SQL, select="""
, changed AS (SELECT record_id FROM rec WHERE k % 40 = 1),
dkey AS (SELECT DISTINCT key FROM rkey JOIN changed USING (record_id)),
prior AS (SELECT o_custkey AS subject_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS prior_run_id FROM orders GROUP BY ALL)
SELECT s.subject_id, prior_run_id FROM subj s LEFT JOIN prior USING (subject_id)
WHERE s.subject_id % 10 <> 3 AND s.subject_id % 17 <> 5
  AND s.subject_id IN (SELECT subject_id FROM svar JOIN skey USING (vname) JOIN dkey USING (key))"""))
def monitoring_rescreen(spark, sf_dir):
    subs = subjects(spark, sf_dir).withColumns({
        "shredded_at": F.when(F.col("subject_id") % 10 == 3, F.lit(AS_OF).cast("timestamp")),
        "relationship_ended_at": F.when(F.col("subject_id") % 17 == 5, F.lit(AS_OF).cast("timestamp")),
        "names": F.concat(F.array("name"), "aliases")})
    recs = records(spark, sf_dir)
    k = F.substring("record_id", 2, 20).cast("bigint")
    delta = recs.select("record_id", F.when(k % 40 == 1, "changed").when(k % 40 == 2, "removed").alias("change")).filter("change IS NOT NULL")
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    changed = monitor.changed_records(delta, recs, "record_id")
    out = monitor.rescreen(changed, subs, monitor.subject_key_table(subs), runs, "snap-2", AS_OF)
    return out.select("subject_id", "prior_run_id")


# Orders as screening runs: every order with status F or O has a decision, part of them human dispositions.
def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    runs = o.select(k.alias("run_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("created_at"),
                    F.when(k % 3 == 0, "monitoring").when(k % 3 == 1, "intake").otherwise("kyb_officer").alias("trigger"))
    decided = o.filter(F.col("o_orderstatus") != "P").select(
        k.alias("run_id"), (k + 1_000_000_000).alias("decision_id"),
        F.when(F.col("o_totalprice") > 400000, "MATCH").when(F.col("o_totalprice") > 100000, "REVIEW").otherwise("CLEAR").alias("disposition"),
        (F.col("o_totalprice") <= 100000).alias("auto_closed"), F.round(F.col("o_totalprice") / 500000, 4).alias("top_score"))
    li = table(spark, sf_dir, "lineitem")
    human = li.groupBy("l_orderkey", "l_linenumber", "l_shipdate").agg(F.max("l_returnflag").alias("f")).select(
        (F.col("l_orderkey") + 1_000_000_000).alias("decision_id"), F.col("l_linenumber").alias("disposition_id"), F.col("l_shipdate").alias("created_at"),
        F.when(F.col("f") == "R", "MATCH").when(F.col("f") == "A", "CLEAR").otherwise("REVIEW").alias("disposition"))
    cands = li.select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("list"), (F.col("l_suppkey") % 4).cast("string")).alias("source"))
    return runs, decided, human, cands


_RUNS_SQL = """
r AS (SELECT o_orderkey AS run_id, o_custkey AS subject_id, o_orderdate AS created_at,
        CASE o_orderkey % 3 WHEN 0 THEN 'monitoring' WHEN 1 THEN 'intake' ELSE 'kyb_officer' END AS trigger FROM orders),
d AS (SELECT o_orderkey AS run_id, o_orderkey + 1000000000 AS decision_id, CASE WHEN o_totalprice > 400000 THEN 'MATCH' WHEN o_totalprice > 100000 THEN 'REVIEW' ELSE 'CLEAR' END AS system_disposition,
        round(o_totalprice / 500000, 4) AS top_score FROM orders WHERE o_orderstatus <> 'P'),
h0 AS (SELECT l_orderkey + 1000000000 AS decision_id, l_linenumber, l_shipdate, max(l_returnflag) AS f FROM lineitem GROUP BY ALL),
h AS (SELECT decision_id, CASE f WHEN 'R' THEN 'MATCH' WHEN 'A' THEN 'CLEAR' ELSE 'REVIEW' END AS human_disposition
      FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY l_shipdate DESC, l_linenumber) AS n FROM h0) WHERE n = 1)"""


@query("screening_queue_page", f"""WITH {_RUNS_SQL}
SELECT run_id, system_disposition, human_disposition, top_score FROM r LEFT JOIN d USING (run_id) LEFT JOIN h USING (decision_id)
ORDER BY CASE system_disposition WHEN 'MATCH' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'CLEAR' THEN 2 ELSE 3 END, created_at DESC, run_id LIMIT 50 OFFSET 20""")
def screening_queue_page(spark, sf_dir):
    runs, decided, human, _c = _runs(spark, sf_dir)
    return queue.screening_queue(runs, decided, human, limit=50, offset=20).select("run_id", "system_disposition", "human_disposition", "top_score")


@query("screening_queue_filtered", f"""WITH {_RUNS_SQL}
SELECT run_id, system_disposition, human_disposition FROM r JOIN d USING (run_id) LEFT JOIN h USING (decision_id)
WHERE system_disposition = 'REVIEW' AND trigger = 'intake' AND created_at <= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = run_id AND l_suppkey % 4 = 2)""")
def screening_queue_filtered(spark, sf_dir):
    runs, decided, human, cands = _runs(spark, sf_dir)
    return queue.screening_queue(runs, decided, human, candidates=cands, disposition="REVIEW", trigger="intake", older_than_days=400,
                                 list_source="list2", as_of=AS_OF, limit=None).select("run_id", "system_disposition", "human_disposition")


@query("latest_dispositions", f"WITH {_RUNS_SQL} SELECT decision_id, human_disposition AS disposition FROM h")
def latest_dispositions(spark, sf_dir):
    return queue.latest_dispositions(_runs(spark, sf_dir)[2]).select("decision_id", "disposition")


@query("visible_runs", "SELECT o_orderkey AS run_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def visible_runs(spark, sf_dir):
    subs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("api_client_id"))
    return queue.visible_runs(_runs(spark, sf_dir)[0], subs, "BUILDING").select("run_id")


# Orders as reports of customers.
def _reports(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    reports = o.select(k.alias("report_id"), k.alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    runs = o.select(k.alias("run_id"), F.col("o_custkey").alias("submission_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("created_at"),
                    F.when(k % 4 == 1, k - 1).alias("supersedes_id"))
    subs = c.select(F.col("c_custkey").alias("submission_id"), F.col("c_name").alias("company_name"), F.concat(F.lower("c_mktsegment"), F.lit(".example")).alias("domain"))
    score = F.round(F.col("o_totalprice") / 5000, 2)
    assess = o.filter(k % 10 != 9).select(k.alias("run_id"), score.alias("overall_score"),
                                          F.when(score <= 30, "pre_clear").when(score >= 70, "escalate").otherwise("review").alias("triage_tier"))
    reviews = o.filter(k % 6 == 0).select(k.alias("run_id"), F.col("o_orderpriority").alias("status"), F.col("o_orderdate").alias("decided_at"))
    return reports, runs, subs, assess, reviews


_SCORE = "round(o_totalprice / 5000, 2)"
_TIER = f"CASE WHEN {_SCORE} <= 30 THEN 'pre_clear' WHEN {_SCORE} >= 70 THEN 'escalate' ELSE 'review' END"


@query("report_list_filtered", f"""
SELECT o_orderkey AS run_id, c_name AS company_name, {_SCORE} AS overall_score FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderkey % 10 <> 9 AND {_TIER} = 'escalate' AND o_orderkey % 6 <> 0 AND (contains(lower(c_name), '00_1') OR contains(lower(c_mktsegment) || '.example', 'mach') OR contains(lower(c_name), 'mach'))""")
def report_list_filtered(spark, sf_dir):
    r = queue.report_list(*_reports(spark, sf_dir), triage_tier="escalate", review_status="pending", q="MACH", limit=None)
    return r.select("run_id", "company_name", "overall_score")


@query("report_list_page", """
SELECT o_orderkey AS report_id, o_orderstatus AS report_status FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50""")
def report_list_page(spark, sf_dir):
    return queue.report_list(*_reports(spark, sf_dir), limit=25, offset=50).select("report_id", "report_status")


@query("report_total", "SELECT count(*) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 6 = 0")
def report_total(spark, sf_dir):
    return queue.total(queue.report_list(*_reports(spark, sf_dir), review_status="reviewed", limit=None))


@query("score_history", f"""
SELECT a.o_orderkey AS run_id, b.o_orderkey AS previous_run, round(a.s - b.s, 4) AS score_change FROM
 (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey - 1 END AS sup, CASE WHEN o_orderkey % 10 <> 9 THEN {_SCORE} END AS s FROM orders) a
 LEFT JOIN (SELECT o_orderkey, {_SCORE} AS s FROM orders WHERE o_orderkey % 10 <> 9) b ON b.o_orderkey = a.sup""".replace("b.o_orderkey AS previous_run", "a.sup AS previous_run"))
def score_history(spark, sf_dir):
    _r, runs, _s, assess, _v = _reports(spark, sf_dir)
    return queue.score_history(runs, assess).select("run_id", F.col("supersedes_id").alias("previous_run"), "score_change")


@query("score_lag", """
SELECT o_orderkey AS run_id, lag(o_orderkey) OVER w AS previous_run_id, lag(CASE WHEN o_orderkey % 10 <> 9 THEN round(o_totalprice / 5000, 2) END) OVER w AS previous_score
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def score_lag(spark, sf_dir):
    _r, runs, _s, assess, _v = _reports(spark, sf_dir)
    return queue.score_lag(runs, assess).select("run_id", "previous_run_id", "previous_score")


@query("latest_run_per_entity", "SELECT o_custkey AS entity_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY o_custkey")
def latest_run_per_entity(spark, sf_dir):
    return queue.latest_run(_reports(spark, sf_dir)[1])


@query("latest_review_per_submission", "SELECT o_custkey AS submission_id, max(o_orderdate) AS decided_at FROM orders WHERE o_orderkey % 6 = 0 GROUP BY o_custkey")
def latest_review_per_submission(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return queue.latest_review(r[4], r[1])


@query("review_upserts", """
WITH a AS (SELECT l_orderkey AS run_id, l_linenumber, CASE WHEN l_linenumber = 1 OR l_linenumber = 4 THEN 'mark' ELSE 'note' END AS kind, max(l_shipdate) AS t, max(l_returnflag) AS f FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum((kind = 'mark')::INT) OVER (PARTITION BY run_id ORDER BY t, l_linenumber) AS m FROM a)
SELECT run_id, string_agg(f, chr(10) ORDER BY t, l_linenumber) AS notes, count(*) FILTER (WHERE kind = 'mark') AS marks FROM r WHERE NOT (kind = 'mark' AND m > 1) GROUP BY run_id""".replace(
    ", count(*) FILTER (WHERE kind = 'mark') AS marks", ", arg_max(CASE WHEN kind = 'mark' THEN f END, CASE WHEN kind = 'mark' THEN t END) AS status"))
def review_upserts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    acts = li.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("action_id")).agg(
        F.max("l_shipdate").alias("acted_at"), F.max("l_returnflag").alias("notes")).withColumns({
            "kind": F.when(F.col("action_id").isin(1, 4), "mark").otherwise("note"),
            "corrections": F.lit(None).cast("map<string,string>")})
    acts = acts.withColumn("status", F.when(F.col("kind") == "mark", F.col("notes")))
    none = acts.filter(F.lit(False)).select("run_id", "status", "notes", "corrections", F.col("acted_at").alias("decided_at"))
    out, _rejects = queue.apply_reviews(none, acts)
    return out.select("run_id", "notes", "status")


@query("audit_log_with_actor", """
SELECT event_id, CASE WHEN user_id % 3 = 0 AND c_name IS NOT NULL THEN c_name WHEN user_id % 3 = 1 AND s_name IS NOT NULL THEN s_name
  WHEN user_id % 3 = 1 THEN 'integration' ELSE 'system' END AS actor
FROM events LEFT JOIN customer ON c_custkey = user_id AND user_id % 3 = 0 LEFT JOIN supplier ON s_suppkey = user_id AND user_id % 3 = 1""")
def audit_log_with_actor(spark, sf_dir):
    u = F.col("user_id")
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(u % 3 == 0, u).alias("operator_id"), F.when(u % 3 == 1, u).alias("api_client_id"))
    ops = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("operator_id"), F.col("c_name").alias("email"))
    clients = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("api_client_id"), F.col("s_name").alias("name"))
    return queue.with_actor(events, ops, clients).select("event_id", "actor")


@query("audit_timeline", "SELECT event_id FROM events WHERE user_id = 7 OR (props ->> '$.k')::INT = 12")
def audit_timeline(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("verification_run_id"),
                                                   F.get_json_object("props", "$.k").alias("submission_id"), F.col("ts").alias("occurred_at"))
    return queue.audit_timeline(events, "7", "12").select("event_id")


@query("audit_newest", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100")
def audit_newest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("occurred_at"))
    return queue.audit_log(events, "error", 100).select("event_id")


@query("run_timing", "SELECT l_orderkey AS run_id, l_linenumber AS stage, l_shipdate, epoch(l_shipdate - o_orderdate)::DOUBLE AS duration_seconds FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def run_timing(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    runs = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage"), "l_shipdate",
                                                            F.col("l_shipdate").alias("completed_at"), F.col("o_orderdate").alias("started_at"))
    return queue.run_timing(runs).select("run_id", "stage", "l_shipdate", "duration_seconds")


@query("run_panels", """
WITH o AS (SELECT l_orderkey AS run_id, (['query_registries', 'analyze_domain', 'consistency_checks'])[l_linenumber % 3 + 1] AS stage,
  CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'N' THEN 'pending' ELSE 'unavailable' END AS status, l_shipdate AS seen FROM lineitem WHERE l_linenumber < 7),
latest AS (SELECT run_id, stage, arg_max(status, (seen, status)) AS status FROM o GROUP BY ALL)
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 <> 0 THEN 86400.0 * (o_orderkey % 9) END AS duration_seconds, coalesce(stages, '') AS stages
FROM orders LEFT JOIN (SELECT run_id, string_agg(stage || '=' || status, ',' ORDER BY stage) AS stages FROM latest GROUP BY run_id) ON run_id = o_orderkey""")
def run_panels(spark, sf_dir):
    k = F.col("o_orderkey")
    began = F.col("o_orderdate").cast("timestamp")
    ended = F.when(k % 4 != 0, began + F.make_dt_interval((k % 9).cast("int")))
    runs = table(spark, sf_dir, "orders").select(k.alias("run_id"), began.alias("started_at"), ended.alias("completed_at"))
    outcomes = table(spark, sf_dir, "lineitem").filter("l_linenumber < 7").select(
        F.col("l_orderkey").alias("run_id"), F.expr("element_at(array('query_registries', 'analyze_domain', 'consistency_checks'), l_linenumber % 3 + 1)").alias("stage"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'N' THEN 'pending' ELSE 'unavailable' END").alias("status"), F.col("l_shipdate").alias("at"))
    pairs = F.transform(F.array_sort(F.map_entries("stages")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return queue.run_panel(runs, outcomes).select("run_id", "duration_seconds", F.array_join(pairs, ",").alias("stages"))
