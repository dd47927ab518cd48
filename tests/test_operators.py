import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievewatch.operators import people, queue, reuse
from sievewatch.operators.risk import risk_scores
from sievewatch.operators.signals import evidence_features, signals
from sievewatch.streaming import streams

EVIDENCE = ("evidence_id string, run_id long, source string, tier int, field string, raw_value string, normalized_value string, confidence double, "
            "raw_payload string, attribution string, fetched_at timestamp, created_at timestamp")
NOW = datetime(2026, 1, 1)


def ev(run, source, tier, field, value, payload=None, i=0):
    return (f"e{run}-{field}-{i}", run, source, tier, field, value, value, 0.9, payload, None, NOW, NOW)


def score(spark, rows, comparisons=(), reuse_rows=()):
    runs = spark.createDataFrame([(1,)], "run_id long")
    cmp = spark.createDataFrame(list(comparisons), "run_id long, field_name string, match_status string, evidence_id string")
    used = spark.createDataFrame(list(reuse_rows), "run_id long, reuse_count long")
    out = risk_scores(signals(runs, evidence_features(spark.createDataFrame(rows, EVIDENCE)), cmp, used, NOW)).first()
    return out, [s["name"] for s in out["signals"]]


def test_empty_run_uses_the_sentinel_scores(spark):
    out, names = score(spark, [ev(2, "web", 3, "web_brand", "x")])
    assert names == ["no_registry_evidence", "infrastructure_data_unavailable", "no_field_comparisons", "fraud_signals_unavailable"]
    assert (out["entity_score"], out["infrastructure_score"], out["representation_score"], out["risk_score"]) == (60.0, 40.0, 35.0, 35.0)
    assert out["triage_tier"] == "review" and out["confidence"] == 0.0


def test_registry_missing_with_another_signal_is_not_fixed(spark):
    out, names = score(spark, [ev(1, "tax_id", 1, "tax_id_status", "not_found")])
    assert names[:2] == ["no_registry_evidence", "tax_id_not_found"] and out["entity_score"] == 100.0


def test_inactive_contains_active(spark):
    _out, names = score(spark, [ev(1, "opencorporates", 1, "registration_status", "Inactive")])
    assert "registry_status_active" in names


def test_critical_and_floor(spark):
    good = [ev(1, "opencorporates", 1, f, "x") for f in ("company_name", "registration_number")] + [
        ev(1, "domain", 2, "domain_age_days", "2000"), ev(1, "domain", 2, "mx_present", "true"), ev(1, "web", 3, "web_employee_footprint", "3")]
    cmp = [(1, f, "match", None) for f in ("company_name", "country_iso", "billing_address")]
    out, _n = score(spark, good, cmp)
    assert out["triage_tier"] == "pre_clear"
    bank = ev(1, "public_records", 1, "public_record", "strong", '{"status":"open","filed_date":"2025-01-01"}')
    bank = (*bank[:5], "bankruptcy", *bank[6:])
    out, names = score(spark, [*good, bank], cmp)
    assert "public_records_open_bankruptcy" in names and out["triage_tier"] == "review"
    out, _n = score(spark, [*good, ev(1, "officer_screening", 1, "officer_screening_result", "MATCH")], cmp)
    assert out["triage_tier"] == "escalate"


@pytest.mark.parametrize("days,group", [(1, None), (3, None), (3, "entity")])
def test_lookback_equals_brute_force(spark, days, group):
    rng = random.Random(5)
    t0 = datetime(2025, 1, 1)
    rows = []
    for i in range(400):
        sub = rng.randrange(40)
        asn = "hot" if rng.random() < 0.5 else f"a{rng.randrange(6)}"
        rows.append((i, asn, sub, sub % 7, t0 + timedelta(hours=rng.choice([6, 12, 24]) * rng.randrange(60))))
    df = spark.createDataFrame(rows, "id int, asn string, sub int, entity int, t timestamp")
    got = {r["id"]: r["reuse_count"] for r in reuse.lookback_reuse(df, "asn", "sub", "t", days, group).collect()}
    want = {i: len({s2 for _j, a2, s2, e2, t2 in rows if a2 == a and t - timedelta(days=days) <= t2 <= t and (e2 != e if group else s2 != s)}) for i, a, s, e, t in rows}
    assert got == want


def test_reuse_with_several_networks(spark):
    rows = spark.createDataFrame([(1, "s1", "e1", "A"), (1, "s1", "e1", "B"), (2, "s2", "e2", "A"), (2, "s2", "e2", "B"), (3, "s3", "e3", "B"), (4, "s4", "e1", "A")],
                                 "run_id int, submission_id string, entity_id string, asn string").withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    assert {r["run_id"]: r["reuse_count"] for r in reuse.asn_reuse(rows, "2026-01-02").collect()} == {1: 2, 2: 3, 3: 2, 4: 1}


def test_people_merge_is_sequential(spark):
    schema = ("run_id int, origin int, pos int, name string, relationship string, role string, dob string, nationality string, ownership_pct double, "
              "source string, provider string, locator string")
    rows = [(1, 0, 0, "Ann  Block", "officer", "ceo", "1970", None, None, "declared", None, "submission"), (1, 0, 1, "ann block", "owner", None, "1971", None, 5.0, "declared", None, "submission"),
            (1, 1, 0, "ANN BLOCK", "owner", "chair", "1970-02", "US", 9.0, "registry", "p", None), (1, 1, 1, "Ann Block", "officer", "ceo", None, "DE", None, "registry", "p", None)]
    df = spark.createDataFrame(rows, schema)
    out = people.merge_people(df.filter("origin = 0"), df.filter("origin = 1")).orderBy("nth").collect()
    assert [(p["name"], p["dob"], p["relationships"], p["roles"], p["nationality"], p["ownership_pct"], len(p["sources"])) for p in out] == [
        ("Ann Block", "1970", ["officer", "owner"], ["ceo", "chair"], "US", 9.0, 3), ("ann block", "1971", ["owner"], [], None, 5.0, 1)]


def test_reviews_merge_and_reject_the_second_mark(spark):
    reviews = spark.createDataFrame([("r1", "open", "first", {"a": "1"}, NOW)], "run_id string, status string, notes string, corrections map<string,string>, decided_at timestamp")
    acts = spark.createDataFrame([
        ("r1", "1", "note", None, "second", {"a": "2", "b": "3"}, NOW), ("r1", "2", "mark", "done", None, None, NOW),
        ("r2", "3", "mark", "done", None, None, NOW), ("r2", "4", "mark", "again", None, None, NOW + timedelta(days=1)), ("r2", "5", "note", None, "n", None, NOW)],
        "run_id string, action_id string, kind string, status string, notes string, corrections map<string,string>, acted_at timestamp")
    out, bad = queue.apply_reviews(reviews, acts)
    rows = {r["run_id"]: r for r in out.collect()}
    assert rows["r1"]["notes"] == "first\nsecond" and rows["r1"]["corrections"] == {"a": "2", "b": "3"} and rows["r1"]["status"] == "open"
    assert rows["r2"]["status"] == "done" and sorted(r["action_id"] for r in bad.collect()) == ["2", "4"]


def test_stream_deduplicates_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "submission_id string, idempotency_key string, submitted_at timestamp"

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        streams.append_stream(streams.intake_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
        return sorted(r[0] for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).select("submission_id").collect())

    land([("a", "k1", NOW), ("b", None, NOW), ("c", None, NOW)])
    assert run() == ["a", "b", "c"]
    land([("d", "k1", NOW), ("e", "k2", NOW)])
    assert run() == ["a", "b", "c", "e"]
