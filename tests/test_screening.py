import pytest
from pyspark.sql import functions as F

from sievewatch.functions.names import key_groups, name_tokens
from sievewatch.operators import blocking, crypto, replay
from sievewatch.operators.decision import freeze, screen, subject_names, unkeyed_records
from sievewatch.operators.pair_terms import score_pairs
from sievewatch.operators.rules import DEFAULT_RULE, add_rule, load_rule, rule_rows
from sievewatch.plans.inputs import records, subjects

SUBJECT = ("subject_id long, name string, original_script_name string, aliases array<string>, dob string, nationality string, pob string, "
           "documents array<struct<type:string,number:string,country:string>>")
RECORD = ("record_id string, names array<string>, dobs array<struct<date:string,year:int,month:int,circa:boolean,from_year:int,to_year:int>>, "
          "pobs array<string>, nationalities array<string>, documents array<struct<type:string,number:string,country:string>>")


def person(name, dob=None, aliases=(), nat=None, pob=None, docs=(), original=None, key=1):
    return (key, name, original, list(aliases), dob, nat, pob, list(docs))


def listed(names, dobs=(), pobs=(), nats=(), docs=(), key="r"):
    keys = ("date", "year", "month", "circa", "from_year", "to_year")
    return (key, list(names), [tuple(d.get(k) for k in keys) for d in dobs], list(pobs), list(nats), list(docs))


def terms(spark, subject, record, rule=DEFAULT_RULE):
    _d, banded = screen(spark.createDataFrame([subject], SUBJECT), spark.createDataFrame([record], RECORD), rule)
    row = banded.first()
    return (None if row is None else [t["name"] for t in row["terms"]]), (None if row is None else row["score"]), (None if row is None else row["band"])


def pair_terms(spark, cases):
    """Term names of explicit (subject, record) pairs, scored in one job."""
    subs = spark.createDataFrame([(i, *s[1:]) for i, (s, _r) in enumerate(cases)], SUBJECT)
    recs = spark.createDataFrame([(str(i), *r[1:]) for i, (_s, r) in enumerate(cases)], RECORD)
    pairs = spark.createDataFrame([(i, str(i)) for i in range(len(cases))], "subject_id long, record_id string")
    scored = score_pairs(pairs, subs, recs, DEFAULT_RULE).orderBy("subject_id").collect()
    return [[t["name"] for t in r["terms"]] for r in scored]


def test_name_terms(spark):
    cases = [
        ("Ivan Petrov", ["Ivan Petrov"], "name_exact_normalized"), ("Ivan Petrov", ["PETROV, Ivan"], "name_token_reordered"),
        ("Bill Stone", ["William Stone"], "name_translit_equivalent"), ("Yusuf Karim", ["Yousuf Ahmed Kareem"], "name_translit_equivalent"),
        ("I. Petrov", ["Ivan Petrov"], "name_initials_compatible"), ("Petrov", ["Ivan Petrov"], "name_partial_overlap"),
        ("Ivan Petrov", ["Ivan Sidorov"], "name_partial_overlap"), ("Ivan Petrov", ["Ivan A B C Petrov"], "name_partial_overlap"),
        # Greedy: the first "Ivan" takes the listed token, the initial has nothing left.
        ("Ivan I Petrov", ["Ivan Petrov"], "name_partial_overlap"), ("Petrov Ivan", ["Zed", "Ivan Petrov"], "name_token_reordered"), ("Zed", ["Ivan"], None)]
    got = pair_terms(spark, [(person(s), listed(n)) for s, n, _w in cases])
    assert got == [[w] if w else [] for _s, _n, w in cases]


def test_dob_terms(spark):
    cases = [
        ("1970-02-03", [{"date": "1970-02-03"}], "dob_full_match"), ("1970", [{"date": "1970-02-03"}], "dob_year_match"),
        ("1970-02-03", [{"year": 1970}], "dob_year_match"), ("1970-02", [{"year": 1970, "month": 3}], "dob_partial_conflict"),
        ("1970", [{"year": 1972, "circa": True}], "dob_within_range"), ("1970", [{"from_year": 1969, "to_year": 1971}], "dob_within_range"),
        ("1970-02-03", [{"date": "1970-02-04"}], "dob_conflict"), ("1970-02-03", [{"date": "1971-01-01", "circa": True}, {"year": 1970}], "dob_year_match"),
        ("1970-02-03", [], None), ("bad", [{"year": 1970}], None)]
    got = pair_terms(spark, [(person("Ivan Petrov", d), listed(["Ivan Petrov"], r)) for d, r, _w in cases])
    assert got == [["name_exact_normalized"] + ([w] if w else []) for _d, _r, w in cases]


def test_documents_places_and_countries(spark):
    s = person("Ivan Petrov", nat="Russia", pob="Arden", docs=[("passport", "AB-1", "RU")])
    blank = person("Ivan Petrov", docs=[("passport", "--", None)])
    got = pair_terms(spark, [
        (s, listed(["Ivan Petrov"], pobs=["Arden, Corvin"], nats=["RU"], docs=[("passport", "ab1", "RU"), ("passport", "zz", "RU")])),
        (s, listed(["Ivan Petrov"], nats=["Iran"], docs=[("passport", "zz", "RU")])),
        (s, listed(["Ivan Petrov"], docs=[("national_id", "zz", "RU")])),
        (blank, listed(["Ivan Petrov"], docs=[("passport", "", None)]))])
    assert [t[1:] for t in got] == [["id_number_match", "nationality_match", "pob_match"], ["id_number_conflict", "nationality_conflict"], [], ["id_number_match"]]


def test_original_script_blocks_but_does_not_score(spark):
    got = terms(spark, person("Zed Quux", original="Иван Петров"), listed(["Ivan Petrov"]))
    assert got == ([], 0.0, "CLEAR")


def test_conflict_floor_and_common_name(spark):
    assert terms(spark, person("Ivan Petrov", "1970-01-01"), listed(["Ivan Petrov"], [{"date": "1980-01-01"}]))[1:] == (0.15, "REVIEW")
    recs = spark.createDataFrame([listed(["Ivan Petrov"], key=f"r{i}") for i in range(10)], RECORD)
    d, b = screen(spark.createDataFrame([person("Ivan Petrov")], SUBJECT), recs, DEFAULT_RULE)
    assert {r["score"] for r in b.collect()} == {0.35} and d.first()["disposition"] == "REVIEW"
    d, b = screen(spark.createDataFrame([person("Ivan Petrov")], SUBJECT), recs.limit(9), DEFAULT_RULE)
    assert {r["score"] for r in b.collect()} == {0.5}


def test_old_rule_without_partial_weight_uses_full_conflict(spark):
    old = {**DEFAULT_RULE, "weights": {k: v for k, v in DEFAULT_RULE["weights"].items() if k != "dob_partial_conflict"}}
    assert terms(spark, person("Ivan Petrov", "1970"), listed(["Ivan Petrov"], [{"year": 1980}]), old)[0] == ["name_exact_normalized", "dob_conflict"]


def test_no_candidates_and_coverage(spark):
    subs, recs = spark.createDataFrame([person("Zed Quux")], SUBJECT), spark.createDataFrame([listed(["Ivan Petrov"])], RECORD)
    assert tuple(screen(subs, recs, DEFAULT_RULE)[0].select("disposition", "auto_closed", "reason").first()) == ("CLEAR", True, "no_candidates")
    gap = F.create_map(F.lit("list:a"), F.lit("unavailable"))
    assert tuple(screen(subs, recs, DEFAULT_RULE, gap)[0].select("disposition", "auto_closed", "reason").first()) == ("REVIEW", False, "auto_clear_blocked_by_coverage")
    other = F.create_map(F.lit("list:a"), F.lit("timeout"))
    assert screen(subs, recs, DEFAULT_RULE, other)[0].first()["disposition"] == "CLEAR"


def brute_force(spark, subs, recs):
    """Candidates per subject by plain loops over all names and records."""
    keyed = lambda df, col: {r[0]: r[1] for r in df.select(col, key_groups(name_tokens(F.col(col)))).distinct().collect()}
    rec_rows = recs.select("record_id", F.explode("names").alias("n"))
    groups = {**keyed(rec_rows, "n"), **keyed(subs.select(F.explode("names").alias("n")), "n")}
    rec_keys = {}
    for r in rec_rows.collect():
        rec_keys.setdefault(r["record_id"], set()).update(k for g in groups[r["n"]] for k in g)
    out = {}
    for s in subs.collect():
        for n in s["names"]:
            want = groups[n]
            keys = {k for g in want for k in g}
            hits = {rid: keys & ks for rid, ks in rec_keys.items() if keys & ks}
            for rid in hits:
                out.setdefault((s["subject_id"], rid), set()).update(hits[rid])
    return {k: tuple(sorted(v)) for k, v in out.items()}


def test_a_partial_match_behind_many_others_is_not_lost(spark):
    """One record matches on the initial alone, behind 250 that share the family name."""
    recs = spark.createDataFrame([listed(["I. Petrov"], key="z"), *(listed(["Boris Petrov"], key=f"r{i}") for i in range(250))], RECORD)
    decisions, banded = screen(spark.createDataFrame([person("Ivan Petrov")], SUBJECT), recs, DEFAULT_RULE)
    assert tuple(decisions.select("disposition", "auto_closed", "n_candidates").first()) == ("REVIEW", False, 251)
    assert banded.where("band = 'REVIEW'").count() == 1


def test_a_name_without_keys_is_never_closed(spark):
    """No subject that nothing could be compared with is cleared, and such list names can be counted."""
    names = ["王小明", "李雷", "De La", "X"]
    recs = spark.createDataFrame([listed([n], key=n) for n in names], RECORD)
    subs = spark.createDataFrame([person(n, key=i) for i, n in enumerate(names)], SUBJECT)
    got = screen(subs, recs, DEFAULT_RULE)[0].select("disposition", "auto_closed", "reason").collect()
    assert [tuple(r) for r in got] == [("REVIEW", False, "name_without_keys")] * 4
    assert unkeyed_records(recs).count() == 4


@pytest.mark.parametrize("native,latin", [
    ("Иван Петров", "Ivan Petrov"), ("Γιωργος", "Giorgos"), ("김철수", "Gimcheolsu"), ("タナカ ゆき", "Yuki Tanaka"), ("גד דן", "Gad Dan"),
    ("გიორგი მაისურაძე", "Giorgi Maisuradze"), ("Արմեն", "Armen"), ("राजेश कुमार", "Rajesha Kumara"), ("สมชาย", "Samchai")])
def test_scripts_meet_their_romanization(spark, native, latin):
    """A list name in another script shares keys with the romanized subject name, so it is a candidate."""
    recs, subs = spark.createDataFrame([listed([native])], RECORD), spark.createDataFrame([person(latin)], SUBJECT)
    assert screen(subs, recs, DEFAULT_RULE)[0].first()["n_candidates"] == 1


def test_blocking_equals_brute_force(spark, sf_dir):
    subs = subjects(spark, sf_dir)
    subs = subs.select("subject_id", subject_names(subs).alias("names")).filter("subject_id < 60")
    extra = spark.createDataFrame([(1000 + i, [n]) for i, n in enumerate(["Mohammed", "Mohammed Ali", "Bill William", "X", "", "Ivan Ivan"])], "subject_id long, names array<string>")
    subs = subs.union(extra)
    recs = records(spark, sf_dir).select("record_id", "names")
    got = {(r["subject_id"], r["record_id"]): tuple(r["matched_keys"]) for r in blocking.block(subs, recs).collect()}
    assert got == brute_force(spark, subs, recs)


def test_rule_versions(spark):
    rules = rule_rows(spark)
    rules = rules.union(add_rule(rules, weights={"pob_match": 0.2}))
    assert load_rule(rules)["version"] == 2 and load_rule(rules)["weights"]["pob_match"] == 0.2 and load_rule(rules, 1)["weights"]["pob_match"] == 0.05


def test_replay_finds_tampering_and_survives_encryption(spark):
    subs = spark.createDataFrame([person("Ivan Petrov", "1970-01-01", key=1), person("Bill Stone", key=2)], SUBJECT)
    recs = spark.createDataFrame([listed(["Ivan Petrov"], [{"date": "1970-01-01"}], key="a"), listed(["William Stone"], key="b")], RECORD)
    d, b = screen(subs, recs, DEFAULT_RULE)
    head, rows = freeze(d, b, subs, recs, DEFAULT_RULE, ["snap"])
    masters = crypto.master_keys(spark, {"m": bytes(32)})
    keys = crypto.new_subject_keys(subs, None, masters, "m").cache()
    sealed = crypto.encrypt(head, keys, masters, "bundle", "decision", "bundle")
    opened = crypto.decrypt(sealed, keys, masters, "bundle", "decision", "plain").drop("bundle", "shredded").withColumnRenamed("plain", "bundle")
    h2, r2 = replay.replay(opened, rows)
    assert replay.diff_results(head, rows, h2, r2).count() == 0
    forged = rows.withColumn("score", F.when(F.col("record_id") == "a", 0.1).otherwise(F.col("score")))
    diffs = replay.diff_results(head, forged, h2, r2).collect()
    assert [(x["field"], x["original"]) for x in diffs] == [("a.score", "0.1")]
    keys.unpersist()


def test_encryption_binds_purpose_and_subject(spark):
    df = spark.createDataFrame([(1, "secret"), (2, "other")], "subject_id long, v string")
    masters = crypto.master_keys(spark, {"m": bytes(range(32))})
    keys = crypto.new_subject_keys(df, None, masters, "m").cache()
    sealed = crypto.encrypt(df, keys, masters, "v", "pii", "v").cache()
    assert {r["plain"] for r in crypto.decrypt(sealed, keys, masters, "v", "pii").collect()} == {"secret", "other"}
    with pytest.raises(Exception, match="does not authenticate"):
        crypto.decrypt(sealed, keys, masters, "v", "other").collect()
    swapped = sealed.withColumn("subject_id", 3 - F.col("subject_id"))
    with pytest.raises(Exception, match="does not authenticate"):
        crypto.decrypt(swapped, keys, masters, "v", "pii").collect()
    with pytest.raises(Exception, match="no usable data key"):
        crypto.encrypt(spark.createDataFrame([(9, "x")], "subject_id long, v string"), keys, masters, "v").collect()
    assert crypto.new_subject_keys(df, keys, masters, "m").count() == 0
    with pytest.raises(ValueError):
        crypto.master_keys(spark, {"m": b"short"})


@pytest.mark.parametrize("name,held", [
    ("王小明", True), ("王小明 Li", True), ("Li 李", True), ("I. Petrov", False), ("Иван Петров", False), ("van der Meer", False), ("X", True), ("Ünal", False), ("", False), ("123", False)])
def test_letters_without_keys_hold_a_name(spark, name, held):
    from sievewatch.operators.decision import without_keys

    assert spark.createDataFrame([(name,)], "n string").select(without_keys(F.col("n"))).first()[0] is held


def test_decisions_are_named_by_run_and_snapshots(spark):
    subs, recs = spark.createDataFrame([person("Zed Quux")], SUBJECT), spark.createDataFrame([listed(["Ivan Petrov"])], RECORD)
    decided = screen(subs, recs, DEFAULT_RULE)
    ids = {freeze(*decided, subs, recs, DEFAULT_RULE, snaps, run)[0].first()["decision_id"] for snaps, run in ((["a"], "1"), (["a"], "2"), (["b"], "1"), (["a"], "1"))}
    assert len(ids) == 3


def test_a_changed_frozen_rule_shows_against_the_stored_one(spark):
    subs = spark.createDataFrame([person("Ivan Petrov", key=1)], SUBJECT).withColumn("rule_version", F.lit(1))
    recs, rules = spark.createDataFrame([listed(["Ivan Petrov"], key="a")], RECORD), rule_rows(spark)
    head, rows = freeze(*screen(subs, recs, rules), subs, recs, rules)
    forged = head.withColumn("bundle", F.regexp_replace("bundle", r'clear_below\\":0.35', r'clear_below\\":0.8'))
    assert forged.first()["bundle"] != head.first()["bundle"]
    assert replay.replay(forged, rows)[0].first()["disposition"] == "CLEAR"
    assert replay.replay(forged, rows, rules)[0].first()["disposition"] == "REVIEW"


def test_a_rule_version_that_is_not_stored_fails(spark):
    subs = spark.createDataFrame([person("Ivan Petrov")], SUBJECT).withColumn("rule_version", F.lit(9))
    with pytest.raises(Exception, match="no rule version 9"):
        screen(subs, spark.createDataFrame([listed(["Ivan Petrov"])], RECORD), rule_rows(spark))[1].collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_at_the_keys_equal_scores_of_all_pairs(spark, monkeypatch, seed):
    """Repeated and missing ids, postings dealt into blocks and rows of one subject: the pairs and scores of ``score_pairs``."""
    import random

    from sievewatch.operators import candidate_scores
    from tests.test_bounded_blocking import people

    monkeypatch.setattr(candidate_scores, "POSTINGS", 3)
    monkeypatch.setattr(candidate_scores, "PEOPLE_A_ROW", 2)
    subs, recs = people(random.Random(seed), 40)
    subs += [(40 + i, *s[1:]) for i, s in enumerate(subs[:10])] + [(3, *subs[4][1:]), subs[5], (None, *subs[6][1:])]
    recs += [("r3", *recs[4][1:]), recs[5], (None, *recs[6][1:])]
    subs, recs = spark.createDataFrame(subs, SUBJECT), spark.createDataFrame(recs, RECORD)
    pairs = blocking.block(subs.select("subject_id", subject_names(subs).alias("names")), recs.select("record_id", "names"))
    want = score_pairs(pairs, subs, recs, {**DEFAULT_RULE, "common_name_threshold": 2})
    got = candidate_scores.score_candidates(subs, subject_names(subs), recs, {**DEFAULT_RULE, "common_name_threshold": 2})
    assert set(got.columns) == set(want.columns)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and want.where("name_frequency > 1").count()
