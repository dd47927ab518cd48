"""Registered queries: network reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewatch.operators.reuse import asn_reuse, asn_rows, lookback_reuse, reuse_level
from sievewatch.plans.base import query, table


def _lookback_sql(days: int, own: str) -> str:
    return f"""WITH e AS (SELECT event_id, ts, user_id, props FROM events)
SELECT a.event_id, count(DISTINCT b.user_id) AS reuse_count FROM e a LEFT JOIN e b
  ON b.props = a.props AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL {days} DAY AND {own} GROUP BY a.event_id"""


def _lookback(spark, sf_dir, days, group=None):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "props", (F.col("user_id") % 10).alias("entity_id"))
    return lookback_reuse(e, "props", "user_id", "ts", days, group).select("event_id", "reuse_count")


@query("reuse_lookback_1_day", _lookback_sql(1, "b.user_id <> a.user_id"))
def reuse_lookback_1_day(spark, sf_dir):
    return _lookback(spark, sf_dir, 1)


@query("reuse_lookback_7_days", _lookback_sql(7, "b.user_id <> a.user_id"))
def reuse_lookback_7_days(spark, sf_dir):
    return _lookback(spark, sf_dir, 7)


@query("reuse_lookback_other_entities", _lookback_sql(7, "b.user_id % 10 <> a.user_id % 10"))
def reuse_lookback_other_entities(spark, sf_dir):
    return _lookback(spark, sf_dir, 7, "entity_id")


@query("asn_reuse_at_scoring_time", """
WITH e AS (SELECT event_id, user_id, user_id % 10 AS entity_id, upper('as' || (props ->> '$.k')) AS asn, ts FROM events)
SELECT a.event_id AS run_id, count(DISTINCT b.user_id) AS reuse_count,
  CASE WHEN count(DISTINCT b.user_id) >= 3 THEN 'ip_asn_reuse_high' WHEN count(DISTINCT b.user_id) >= 1 THEN 'ip_asn_reuse' END AS signal
FROM e a LEFT JOIN e b ON a.asn = b.asn AND b.ts >= TIMESTAMP '2024-01-29' AND a.entity_id <> b.entity_id GROUP BY a.event_id""")
def asn_reuse_at_scoring_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("submission_id"), (F.col("user_id") % 10).alias("entity_id"))
    ev = e.select(F.col("event_id").alias("run_id"), F.lit("ip_asn").alias("field"), F.concat(F.lit("as"), F.get_json_object("props", "$.k")).alias("normalized_value"),
                  F.lit(None).cast("string").alias("raw_value"), F.col("ts").alias("created_at"))
    out = asn_reuse(asn_rows(ev, runs), "2024-01-31 00:00:00", days=2)
    return out.withColumn("signal", reuse_level(F.col("reuse_count")))


# Every event is a submission of one entity with the network of its key; of three events two also have a wider network.
@query("asn_reuse_several_networks", """
WITH e AS (SELECT event_id, user_id % 10 AS entity_id, 'AS' || (props ->> '$.k') AS n, ts,
  CASE WHEN event_id % 3 <> 0 THEN 'WIDE' || floor((props ->> '$.k')::INT / 30)::INT END AS w FROM events)
SELECT a.event_id AS run_id, count(b.event_id) AS reuse_count FROM e a LEFT JOIN e b
  ON (a.n = b.n OR a.w = b.w) AND b.ts >= TIMESTAMP '2024-01-29' AND a.entity_id <> b.entity_id GROUP BY a.event_id""")
def asn_reuse_several_networks(spark, sf_dir):
    key = F.get_json_object("props", "$.k")
    wide = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("wide"), F.floor(key.cast("int") / 30).cast("string")))
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("run_id"), F.lit("ip_asn").alias("field"), F.explode(F.array_compact(F.array(F.concat(F.lit("as"), key), wide))).alias("normalized_value"),
                    F.lit(None).cast("string").alias("raw_value"), F.col("ts").alias("created_at"))
    runs = e.select(F.col("event_id").alias("run_id"), F.col("event_id").alias("submission_id"), (F.col("user_id") % 10).alias("entity_id"))
    return asn_reuse(asn_rows(rows, runs), "2024-01-31 00:00:00", days=2)
