"""Headline queries at one scale factor; prints one JSON line.

``BENCH_SF_DIR`` is the table folder (default sf0.1), ``BENCH_CPUS`` the number of local cores.
Every query runs to the end into a no-op sink, so all of its output is computed.
"""

from __future__ import annotations

import json
import os
import time

from sievewatch.plans.catalog import QUERIES
from sievewatch.session import local_session

HEADLINE = (
    "screen_subjects", "blocking_candidates", "monitoring_rescreen", "snapshot_delta", "reuse_lookback_7_days",
    "asn_reuse_at_scoring_time", "company_risk_scores", "signal_evidence_links", "assembled_reports", "field_comparisons",
    "exclusion_matches", "bankruptcy_records", "merged_people", "web_page_evidence", "document_contacts",
    "retention_counts", "screening_queue_page", "report_list_page", "exclusions_file",
)
# What one query works through, for the throughput figures.
UNITS = {
    "screen_subjects": ("customer", "subjects"), "snapshot_delta": ("orders", "rows"), "reuse_lookback_7_days": ("events", "rows"),
    "company_risk_scores": ("orders", "runs"), "web_page_evidence": ("pages", "pages"), "document_contacts": ("documents", "documents"),
    "exclusions_file": ("part", "rows"),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("sievewatch-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small):  # warm the JVM up on the smallest tables
        for name in ("screen_subjects", "company_risk_scores"):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    rates = {}
    for name, (table, unit) in UNITS.items():
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
        rates[name] = {"value": round(rows / seconds[name], 1), "unit": f"{unit}/s"}
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "throughput": rates, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
