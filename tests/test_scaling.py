"""Plans that must not depend on the size of the files they read."""

import re

import __spark_entry__ as entry
import pytest

from sievewatch.functions.dates import DOB_TYPE
from sievewatch.operators.blocking import block
from sievewatch.operators.pair_terms import DOC_TYPE, score_pairs, with_pair_inputs
from sievewatch.operators.rules import DEFAULT_RULE


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["field_comparisons", "blocking_candidates", "screen_subjects", "screen_subjects_bounded"])
def test_rows_derived_from_small_files_are_broadcast_only_by_measured_size(spark, sf_dir, name):
    plan = initial_plan(entry.queries()[name](spark, sf_dir))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize(("name", "step"), [
    ("exclusion_matches", r"SortMergeJoin \[_group#\d+, _share#"),  # ranked once per name and state
    ("company_sanctions", r"Exchange hashpartitioning\(company_name#\d+, _share#"),  # a name's answers meet its runs
    ("entity_resolution", r"windowspecdefinition\(_s#"),  # the first two of a name and host, not of every run
    ("linked_people", r"Aggregate\(keys?=\[entity_id#[^\]]*_dob#"),  # known people once
])
def test_rows_that_runs_share_are_made_once(spark, sf_dir, name, step):
    assert re.search(step, initial_plan(entry.queries()[name](spark, sf_dir)))


def test_evidence_meets_signals_by_run_alone(spark, sf_dir):
    assert not re.search(r"hashpartitioning\(run_id#\d+L?, signal#", initial_plan(entry.queries()["signal_evidence_links"](spark, sf_dir)))


@pytest.mark.parametrize("name", ["assembled_reports", "report_sections", "layer_explanations"])
def test_reports_score_runs_once(spark, sf_dir, name):
    plan = initial_plan(entry.queries()[name](spark, sf_dir))
    assert "has_registry" not in plan and "hashpartitioning(run_id#" in plan and ", layer#" not in "".join(re.findall(r"hashpartitioning\([^)]*", plan))


def test_a_short_table_is_dealt_out(spark, sf_dir):
    assert "Exchange hashpartitioning(c_custkey#" in initial_plan(entry.queries()["script_names"](spark, sf_dir))


def test_replay_reads_stored_decisions_and_scores_them_once(spark, sf_dir):
    plan = initial_plan(entry.queries()["replay_decisions"](spark, sf_dir))
    assert "c_custkey" not in plan and "p_partkey" not in plan and "best_name" not in plan and "Window" not in plan


def test_scoring_carries_no_keys_of_names_that_blocking_has_ranked(spark):
    subjects = spark.createDataFrame([(1, "Ivan Petrov")], "subject_id long, name string")
    records = spark.createDataFrame([("a", ["Petrov, Ivan"])], "record_id string, names array<string>").selectExpr(
        "*", *(f"CAST(NULL AS {t}) AS {c}" for c, t in (("dobs", f"array<{DOB_TYPE}>"), ("pobs", "array<string>"), ("nationalities", "array<string>"), ("documents", DOC_TYPE))))
    pairs = block(subjects.selectExpr("subject_id", "array(name) AS names"), records, compare=True)
    row = with_pair_inputs(pairs, subjects, records).select("s.forms", "r.forms").first()
    assert [t.k for forms in row for f in forms for t in f.tokens] == [[]] * 4
    assert score_pairs(pairs, subjects, records, DEFAULT_RULE).first().terms[0].name == "name_token_reordered"


@pytest.mark.parametrize("name", ["screen_subjects", "screen_with_coverage_gap", "pair_scores", "explain_candidates", "explain_dispositions", "provenance_claims"])
def test_no_pair_is_shuffled_with_what_it_is_scored_by(spark, sf_dir, name):
    """People meet at their keys: no side of a join on the key of a record or of a blocked name, and no window counts pairs."""
    plan = initial_plan(entry.queries()[name](spark, sf_dir))
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert "SortMergeJoin [key#" in plan and not any(d.startswith("name_key#") for d in dealt)
    assert not re.search(r"windowspecdefinition\(subject_id#\d+L?, specifiedwindow[^\n]*_full", plan)


def test_resolution_shuffles_one_token_array_a_row(spark, sf_dir):
    plan = initial_plan(entry.queries()["resolved_candidates"](spark, sf_dir))
    keyed = re.findall(r"Project \[([^\n]*_k#\d+\.kind AS kind[^\n]*)\]", plan)
    assert keyed and not any("_tokens" in row for row in keyed)


def test_stream_screens_a_batch_once(spark, sf_dir, monkeypatch):
    from sievewatch.streaming import streams

    plans, append = {}, streams.append_table

    def noted(df, path, keys):
        plans[tuple(df.columns)] = df._jdf.queryExecution().withCachedData().toString()
        append(df, path, keys)

    monkeypatch.setattr(streams, "append_table", noted)
    entry.queries()["stream_screening"](spark, sf_dir)
    decided = next(p for columns, p in plans.items() if "disposition" in columns)
    assert re.search(r"InMemoryRelation \[[^\]]*\bband#", decided)


def test_dispositions_are_dealt_by_rows_not_by_bytes(spark, sf_dir, monkeypatch):
    from sievewatch.plans import base

    monkeypatch.setattr(base, "PART_ROWS", 1000)
    rows = base.table(spark, sf_dir, "lineitem").count()
    plan = initial_plan(entry.queries()["appended_dispositions"](spark, sf_dir))
    dealt = re.findall(r"hashpartitioning\(decision_id#\d+L?(?:, disposition_id#\d+L?)?, (\d+)\), REPARTITION_BY_NUM", plan)
    assert len(dealt) >= 2 and set(dealt) == {str(-(-rows // 1000))}
