import random

import pytest
from pyspark.sql import functions as F

from sievewatch.operators.bounded_blocking import all_keyed_names, bounded_candidates, least_evidence, screen_bounded, token_dictionary
from sievewatch.operators.decision import screen
from sievewatch.operators.rules import DEFAULT_RULE
from sievewatch.plans.inputs import records, subjects
from tests.test_screening import RECORD, SUBJECT

HEAD = ["subject_id", "disposition", "auto_closed", "reason", "n_match", "n_review"]


def people(rng, n):
    """Few tokens, initials, nicknames and other scripts, so that every way to pair tokens occurs."""
    tokens = ["Ivan", "Iwan", "Petrov", "Petrow", "Bill", "William", "I.", "P.", "B", "W.", "Ali", "A.", "Katherine", "Kate", "Иван", "小明", "van"]
    dob = lambda: rng.choice([None, "1970-02-03", "1970-02", "1970", "1972", "1999"])
    docs = lambda: [("passport", rng.choice(["A1", "a-1", "B2"]), "RU")] if rng.random() < 0.3 else []
    name = lambda: " ".join(rng.choices(tokens, k=rng.choice([1, 2, 2, 2, 3, 3, 4])))
    dobs = [{"date": "1970-02-03"}, {"year": 1970}, {"year": 1972, "circa": True}, {"from_year": 1960, "to_year": 1975}, {"date": "1999-01-01"}]
    fields = ("date", "year", "month", "circa", "from_year", "to_year")
    subs = [(i, name(), rng.choice([None, None, "Иван"]), [name() for _ in range(rng.choice([0, 0, 1]))], dob(), rng.choice([None, "RU", "Iran"]), rng.choice([None, "Arden", "Corvin"]), docs())
            for i in range(n)]
    recs = [(f"r{i}", [name() for _ in range(rng.choice([1, 1, 2]))], [tuple(d.get(k) for k in fields) for d in rng.sample(dobs, rng.choice([0, 1, 1, 2]))],
             rng.choice([[], ["Arden, Ruritania"]]), rng.choice([[], ["RU"], ["Iran", "DE"]]), docs()) for i in range(n)]
    return subs, recs


LOW = {**DEFAULT_RULE, "thresholds": {"clear_below": 0.3, "match_at": 0.6}}
ALL = {**DEFAULT_RULE, "thresholds": {"clear_below": 0.15, "match_at": 0.6}}


@pytest.mark.parametrize("rule", [DEFAULT_RULE, LOW, ALL], ids=["default", "low", "all"])
def test_decisions_equal_all_pairs(spark, rule):
    subs, recs = people(random.Random(3), 70)
    subs, recs = spark.createDataFrame(subs, SUBJECT), spark.createDataFrame(recs, RECORD)
    whole, every = screen(subs, recs, rule)
    decided, built = screen_bounded(subs, recs, rule)
    cut = ["subject_id", "record_id", "band", "score", F.array_join("matched_keys", " ").alias("keys")]
    want = {tuple(r) for r in every.where("band <> 'CLEAR'").select(*cut).collect()}
    assert {tuple(r) for r in built.where("band <> 'CLEAR'").select(*cut).collect()} == want and want
    assert {tuple(r) for r in decided.select(*HEAD).collect()} == {tuple(r) for r in whole.select(*HEAD).collect()}


def test_least_evidence():
    assert least_evidence(DEFAULT_RULE) == [("dob",), ("id",), ("country", "place")]
    assert least_evidence(LOW) == [("dob",), ("id",), ("country",)]
    assert least_evidence(ALL) == [()]


def test_built_pairs_on_a_vocabulary_that_does_not_grow(spark, sf_dir):
    """All names from the first block: decisions as from all pairs, of which a part is built."""
    subs, recs = subjects(spark, sf_dir, common=1), records(spark, sf_dir, common=1)
    whole, every = screen(subs, recs, DEFAULT_RULE)
    decided, built = screen_bounded(subs, recs, DEFAULT_RULE)
    assert {tuple(r) for r in decided.select(*HEAD).collect()} == {tuple(r) for r in whole.select(*HEAD).collect()}
    n_all, n_built = every.count(), built.count()
    assert n_built < 0.5 * n_all


def test_the_dictionary_keys_only_new_tokens(spark, tmp_path):
    names = spark.createDataFrame([("ivan petrov",), ("ivan",), ("",)], "name_key string")
    assert token_dictionary(names, str(tmp_path / "d")).count() == 2
    more = names.union(spark.createDataFrame([("ivan stone",)], "name_key string"))
    held = token_dictionary(more, str(tmp_path / "d"))
    assert sorted(r.token for r in held.collect()) == ["ivan", "petrov", "stone"]
    assert {r.token: r["keys"] for r in held.collect()} == {r.token: r["keys"] for r in token_dictionary(more).collect()}
