import pytest
from pyspark.sql import functions as F

from sievewatch.functions import contacts, dates, geo, names, register, text


def values(spark, build, inputs):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", build(F.col("v")).alias("out"))
    return [r["out"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_name_tokens(spark):
    out = values(spark, names.name_tokens, ["Müller-Lind van der Berg", "XiJinPing", "Владимир Орлов", "محمد", " ", None, "AL-Karim bin Said", "Zoë Ångström"])
    assert out == [["muller", "lind", "berg"], ["xi", "jin", "ping"], ["vladimir", "orlov"], ["mhmd"], [], [], ["karim", "said"], ["zoe", "angstrom"]]


def test_skeleton(spark):
    assert values(spark, names.skeleton, ["yulia", "ksenia", "khalid", "philip", "aaa", "mohammed"]) == ["il", "xn", "hld", "flp", "a", "mhmd"]


@pytest.mark.parametrize("word,code", [
    ("metaphone", "MTFN"), ("knight", "NT"), ("wright", "RT"), ("thumb", "0M"), ("school", "SXL"), ("judge", "JJ"),
    ("phone", "FN"), ("nation", "NXN"), ("xavier", "SFR"), ("wheat", "WT"), ("cia", "X"), ("science", "SSNS"), ("42", "")])
def test_metaphone(spark, word, code):
    assert values(spark, names.metaphone, [word]) == [code]


def test_nicknames_share_keys_and_initials_have_none(spark):
    bill, william, w = values(spark, names.name_keys, ["Bill", "William", "W"])
    assert set(bill) & set(william) and w == []


def test_company_names(spark):
    assert values(spark, text.core_name, ["Acme Corporation Inc.", "Co Ltd", "Inc", "Foo & Bar, L.L.C.", None]) == ["acme", "co", "inc", "foo bar", ""]
    assert values(spark, text.sanctions_key, ["Acme Corporation Inc.", "Acme, Ltd.", "ACME  GmbH"]) == ["acme corporation", "acme", "acme"]


def test_addresses_of_networks(spark):
    out = values(spark, text.truncate_ip, ["10.1.2.3", "2001:db8:1:2::9", "::1", "999.1.1.1", "", "10.0.0.0/24", "1:2:3:4:5:6:7:8:9", "1::2::3", "2001:0:0:1::5"])
    assert out == ["10.1.2.0/24", "2001:db8:1::/48", "::/48", None, None, None, None, None, "2001::/48"]


def test_small_normalizers(spark):
    assert values(spark, text.fein, ["12-3456789", "12", None]) == ["123456789", None, None]
    assert values(spark, text.numbered, ["(1) A (2) B 0", "plain", "", None]) == [["A", "B 0"], ["plain"], [], []]
    assert values(spark, text.domain, ["HTTPS://A.example:80/x?y", " ", None]) == ["a.example", None, None]
    assert values(spark, text.bare_host, ["http://www.a.example/x", "b.example:1"]) == ["a.example", "b.example"]
    assert values(spark, text.page_url, ["x LinkedIn.com/company/Ab-C/about", "other"]) == ["https://www.linkedin.com/company/ab-c", None]
    assert values(spark, text.debtor_name, ["Acme, LLC, et al.", "Acme et al"]) == ["Acme, LLC", "Acme"]
    assert values(spark, text.like_pattern, ["50%_\\"]) == ["%50\\%\\_\\\\%"]


def test_truthy_falls_through_empty_text(spark):
    df = spark.createDataFrame([("", "true"), ("no", "true"), (None, "YES"), (None, None)], "n string, r string")
    assert [r[0] for r in df.select(text.truthy(F.col("n"), F.col("r"))).collect()] == [True, False, True, False]


def test_dates(spark):
    out = values(spark, dates.ofac_dob, ["01 Jan 1970", "31 Feb 1970", "circa 1960", "Mar 1960", "1950 to 1955", "junk"])
    assert [None if o is None else {k: v for k, v in o.asDict().items() if v is not None} for o in out] == [
        {"date": "1970-01-01"}, {"year": 1970, "month": 2}, {"year": 1960, "circa": True}, {"year": 1960, "month": 3}, {"from_year": 1950, "to_year": 1955}, None]
    out = values(spark, dates.uk_dob, ["00/00/1970", "00/05/1970", "05/06/1971", "x"])
    assert [None if o is None else (o["date"], o["year"], o["month"]) for o in out] == [(None, 1970, None), (None, 1970, 5), ("1971-06-05", None, None), None]


def test_countries(spark):
    assert values(spark, geo.iso2, ["Russian Federation", "korea, north", "Côte d'Ivoire", "ir", "Myanmar", "Congo", "Atlantis", None]) == ["RU", "KP", "CI", "IR", "MM", "CG", None, None]
    assert values(spark, geo.company_country, ["XY", "germany", "Narnia"]) == ["XY", "DE", None]


def test_contacts(spark):
    page = ("<html><title> T </title><meta property='og:site_name' content='Brand Co'><p>mail A@Acme.example or x@example.com, hero@2x.png, b@other.example "
            "call +1 (323) 555-9830; or 100000000000; at 12 Long Harbor Street</p></html>")
    df = spark.createDataFrame([(page,)], "html string").withColumn("t", contacts.strip_tags(F.col("html")))
    row = df.select(contacts.page_brand(F.col("html")).alias("b"), contacts.clean_emails(contacts.find_emails(F.col("t")), F.lit("other.example")).alias("e"),
                    contacts.clean_phones(contacts.find_phones(F.col("t"))).alias("p"), contacts.find_addresses(F.col("t")).alias("a")).first()
    assert row["b"] == "Brand Co" and row["e"] == ["b@other.example", "a@acme.example"]
    assert row["p"] == ["+1 (323) 555-9830"] and row["a"] == ["12 Long Harbor Street"]


def test_sql_functions(spark):
    assert "explode_name_keys" in register.register_functions(spark)
    row = spark.sql("SELECT name_tokens('Bill van Dam') AS t, metaphone('phone') AS m, iso2('UK') AS c").first()
    assert (row["t"], row["m"], row["c"]) == (["bill", "dam"], "FN", "GB")
    assert spark.sql("SELECT * FROM explode_name_keys('Bill')").count() == 4
