import pytest
from pyspark.sql import functions as F

from sievewatch.operators import lists
from sievewatch.sources import lists as files
from sievewatch.sources import sinks


def test_ofac_file(spark, tmp_path):
    (tmp_path / "sdn.csv").write_text(
        '1,"DOE, Jon Q","individual","PROG"," -0- "," -0- "," -0- "," -0- "," -0- "," -0- "," -0- ","DOB 01 Jan 1970; alt. DOB circa 1971; POB Arden; nationality Belmora; '
        'alt. citizen Corvin; Gender Male; Passport A1 (Arden); National ID No. 77 (Belmora); a.k.a. \'ROE, Jim\'; f.k.a. \'OLD NAME\'."\n'
        '2,"SHIP ONE"," -0- ","PROG"," -0- "," -0- "," -0- "," -0- "," -0- "," -0- "," -0- "," -0- "\n')
    rows = files.read_ofac(spark, str(tmp_path / "sdn.csv")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["primary_name"] == "Jon Q DOE"
    assert [(n["name"], n["kind"]) for n in r["names"]] == [("DOE, Jon Q", "primary"), ("Jon Q DOE", "primary"), ("Jim ROE", "aka"), ("OLD NAME", "fka")]
    assert [(d["date"], d["year"], d["circa"]) for d in r["dobs"]] == [("1970-01-01", None, None), (None, 1971, True)]
    assert r["pobs"] == ["Arden"] and r["nationalities"] == ["Belmora", "Corvin"] and r["gender"] == "Male"
    assert [(d["type"], d["number"], d["country"]) for d in r["documents"]] == [("passport", "A1", "Arden"), ("national_id", "77", "Belmora")]


def test_un_file(spark, tmp_path):
    (tmp_path / "un.xml").write_text(
        "<CONSOLIDATED_LIST><INDIVIDUALS><INDIVIDUAL><DATAID>9</DATAID><FIRST_NAME>Ann</FIRST_NAME><THIRD_NAME>Block</THIRD_NAME><UN_LIST_TYPE>L</UN_LIST_TYPE>"
        "<NATIONALITY><VALUE>Arden</VALUE><VALUE>Belmora</VALUE></NATIONALITY><INDIVIDUAL_ALIAS><QUALITY>Good</QUALITY><ALIAS_NAME>Annie</ALIAS_NAME></INDIVIDUAL_ALIAS>"
        "<INDIVIDUAL_ALIAS><QUALITY/><ALIAS_NAME/></INDIVIDUAL_ALIAS><INDIVIDUAL_DATE_OF_BIRTH><TYPE_OF_DATE>BETWEEN</TYPE_OF_DATE><FROM_YEAR>1960</FROM_YEAR><TO_YEAR>1962</TO_YEAR></INDIVIDUAL_DATE_OF_BIRTH>"
        "<INDIVIDUAL_DATE_OF_BIRTH><TYPE_OF_DATE>APPROXIMATELY</TYPE_OF_DATE><YEAR>1961</YEAR></INDIVIDUAL_DATE_OF_BIRTH><INDIVIDUAL_PLACE_OF_BIRTH><CITY>C</CITY><COUNTRY>D</COUNTRY></INDIVIDUAL_PLACE_OF_BIRTH>"
        "<INDIVIDUAL_DOCUMENT><TYPE_OF_DOCUMENT>National Identification Number</TYPE_OF_DOCUMENT><NUMBER>5</NUMBER><COUNTRY_OF_ISSUE>D</COUNTRY_OF_ISSUE></INDIVIDUAL_DOCUMENT>"
        "</INDIVIDUAL></INDIVIDUALS><ENTITIES><ENTITY><DATAID>1</DATAID></ENTITY></ENTITIES></CONSOLIDATED_LIST>")
    (r,) = files.read_un(spark, str(tmp_path / "un.xml")).collect()
    assert r["primary_name"] == "Ann Block" and [n["name"] for n in r["names"]] == ["Ann Block", "Annie"] and r["names"][1]["quality"] == "good"
    assert [(d["from_year"], d["to_year"], d["year"], d["circa"]) for d in r["dobs"]] == [(1960, 1962, None, None), (None, None, 1961, True)]
    assert r["pobs"] == ["C, D"] and r["nationalities"] == ["Arden", "Belmora"] and r["documents"][0]["type"] == "national_id" and r["documents"][0]["country"] == "D"


def test_eu_file(spark, tmp_path):
    (tmp_path / "eu.xml").write_text(
        '<export xmlns="http://eu.europa.ec/fpi/fsd/export"><sanctionEntity logicalId="7"><regulation programme="P"/><subjectType code="person"/>'
        '<nameAlias wholeName="Ann Block" gender="F" nameLanguage="EN" strong="true"/><nameAlias wholeName="A. Block" strong="false"/>'
        '<birthdate year="1970" monthOfYear="3" circa="true" city="C" countryIso2Code="00"/><citizenship countryIso2Code="DE"/><citizenship countryIso2Code="00"/>'
        '<identification identificationTypeCode="id" number="5" countryIso2Code="DE"/></sanctionEntity>'
        '<sanctionEntity logicalId="8"><subjectType code="enterprise"/><nameAlias wholeName="Firm"/></sanctionEntity></export>')
    (r,) = files.read_eu(spark, str(tmp_path / "eu.xml")).collect()
    assert r["source_entry_id"] == "7" and r["primary_name"] == "Ann Block" and r["gender"] == "F" and r["program"] == "P"
    assert [(n["name"], n["kind"], n["quality"], n["language"]) for n in r["names"]] == [("Ann Block", "primary", None, "EN"), ("A. Block", "aka", "low", None)]
    assert (r["dobs"][0]["year"], r["dobs"][0]["month"], r["dobs"][0]["circa"]) == (1970, 3, True)
    assert r["pobs"] == ["C"] and r["nationalities"] == ["DE"] and r["documents"][0]["type"] == "national_id"


def test_uk_file(spark, tmp_path):
    head = ["Name 6", "Name 1", "Name 2", "Name 3", "Name 4", "Name 5", "Name Non-Latin Script", "DOB", "Town of Birth", "Country of Birth", "Nationality", "Passport Number",
            "National Identification Number", "Group Type", "Alias Type", "Alias Quality", "Regime", "Group ID"]
    rows = [["BLOCK", "Annie", "", "", "", "", "", "", "", "", "", "", "", "Individual", "AKA", "Low", "R", "5"],
            ["BLOCK", "Ann", "", "", "", "", "", "(1) 00/00/1970 (2) 05/06/1971", "C", "D", "(1) X (2) Y", "P10", "", "Individual", "Primary name", "", "R", "5"],
            ["SHIP", "", "", "", "", "", "", "", "", "", "", "", "", "Ship", "Primary name", "", "R", "6"]]
    (tmp_path / "uk.csv").write_text("﻿Last Updated,01/01/2026\n" + "\n".join(",".join(f'"{c}"' for c in r) for r in [head, *rows]) + "\n", encoding="utf-8")
    (r,) = files.read_uk(spark, str(tmp_path / "uk.csv")).collect()
    assert r["primary_name"] == "Ann BLOCK" and [(n["name"], n["kind"], n["quality"]) for n in r["names"]] == [("Ann BLOCK", "primary", None), ("Annie BLOCK", "aka", "low")]
    assert [(d["year"], d["date"]) for d in r["dobs"]] == [(1970, None), (None, "1971-06-05")]
    assert r["pobs"] == ["C, D"] and r["nationalities"] == ["X", "Y"] and r["documents"][0]["number"] == "P10"


def test_exclusions_file(spark, tmp_path):
    cols = list(files.EXCLUSION_COLUMNS)
    def line(**kw):
        return ",".join(f'"{kw.get(c.split(" ")[0], "")}"' for c in cols)
    (tmp_path / "x.csv").write_text(",".join(f'"{c}"' for c in cols) + "\n"
        + ",".join(['"Firm"', '"Acme, Inc."', '""', '""', '"C"', '"TX"', '"USA"', '""', '""', '""', '""', '"2020-01-02"', '"Indefinite"', '"Old Acme; B"', '"S1"', '""']) + "\n"
        + ",".join(['"Individual"', '""', '"Ann"', '"Block"', '""', '""', '""', '""', '""', '""', '""', '"01/02/2020"', '"03/04/2021"', '""', '"S2"', '""']) + "\n"
        + ",".join(['"Firm"', '"No number"'] + ['""'] * 14) + "\n")
    good, bad = files.read_exclusions(spark, str(tmp_path / "x.csv"))
    rows = {r["sam_number"]: r for r in good.collect()}
    assert bad.count() == 1 and rows["S1"]["core_name"] == "acme" and rows["S1"]["termination_indefinite"] and str(rows["S1"]["active_date"]) == "2020-01-02"
    assert rows["S2"]["core_name"] == "ann block" and str(rows["S2"]["termination_date"]) == "2021-03-04"
    (tmp_path / "y.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_exclusions(spark, str(tmp_path / "y.csv"))


def test_ingest_guards(spark):
    good, bad = spark.range(100), spark.range(4)
    assert lists.check_ingest(good, bad, None).first()["accepted"]
    assert lists.check_ingest(good, spark.range(6), None).first()["reason"] == "too many unusable rows"
    assert lists.check_ingest(good, bad, 300).first()["reason"] == "row count collapsed"
    assert lists.check_ingest(spark.range(0), bad, None).first()["reason"] == "no usable rows"
    assert lists.check_ingest(good, bad, None, ("a",), ("a", "b")).first()["reason"] == "missing columns: b"


def test_previous_snapshot_skips_equal_times(spark):
    snaps = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "c", 2), ("s", "d", 3)], "source string, snapshot_id string, retrieved_at int")
    out = {r["snapshot_id"]: r["previous_id"] for r in lists.with_previous(snaps).collect()}
    assert out == {"a": None, "b": "a", "c": "a", "d": "b"}


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5).withColumn("v", F.lit(1))
    sinks.append_table(df, path, ["id"])
    sinks.append_table(df.union(spark.range(5, 7).withColumn("v", F.lit(1))), path, ["id"])
    assert spark.read.parquet(path).count() == 7


def test_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"watchlist": [{"id": "w1", "primary_name": "A B", "names": [{"name": "A B", "kind": "primary"}], "dobs": [{"year": 1970}], "pobs": [], "nationalities": [], "documents": []}],'
                                     ' "cases": [{"id": "c1", "category": "clean", "subject": {"name": "A B", "documents": []}, "expected_hits": ["w1"]}]}')
    watch, cases = sinks.read_corpus(spark, str(tmp_path / "c.json"))
    assert watch.first()["names"] == ["A B"] and cases.first()["expected_hits"] == ["w1"]
