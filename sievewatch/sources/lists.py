"""Sanctions and exclusion list files -> one person-record or exclusion-record shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewatch.functions.dates import DOB_TYPE, dob, ofac_dob, uk_dob, year_of
from sievewatch.functions.text import core_name, numbered

NAME_TYPE = "struct<name:string,kind:string,script:string,quality:string,language:string>"
DOC_TYPE = "struct<type:string,number:string,country:string>"
_STRINGS = "array<string>"


def person_name(name: Column, kind: Column | str, script: Column | str | None = None,
                quality: Column | None = None, language: Column | None = None) -> Column:
    def text(v) -> Column:
        return (v if isinstance(v, Column) else F.lit(v)).cast("string")

    return F.struct(name.alias("name"), text(kind).alias("kind"), text(script).alias("script"),
                    text(quality).alias("quality"), text(language).alias("language"))


def document(kind: Column | str, number: Column, country: Column | None = None) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).cast("string").alias("type"), number.alias("number"),
                    (F.lit(None) if country is None else country).cast("string").alias("country"))


def compact(items: Column, kind: str) -> Column:
    """Drop NULLs and repeats, keep the first-seen order; NULL becomes an empty array."""
    return F.array_distinct(F.filter(F.coalesce(items, F.array().cast(f"array<{kind}>")), lambda x: x.isNotNull()))


def blank(c: Column) -> Column:
    """Trimmed text, NULL when empty."""
    return F.nullif(F.trim(c), F.lit(""))


def _persons(df: DataFrame, source: str) -> DataFrame:
    names = F.filter(compact(F.col("names"), NAME_TYPE), lambda n: F.coalesce(n["name"], F.lit("")) != "")
    return df.select(
        F.lit(source).alias("source"), "source_entry_id", "primary_name", names.alias("names"),
        compact(F.col("dobs"), DOB_TYPE).alias("dobs"),
        F.filter(compact(F.col("pobs"), "string"), lambda x: x != "").alias("pobs"),
        F.filter(compact(F.col("nationalities"), "string"), lambda x: x != "").alias("nationalities"),
        compact(F.col("documents"), DOC_TYPE).alias("documents"), "gender", "program",
    )


# --- OFAC -----------------------------------------------------------------------------------

_SDN_COLUMNS = ("id", "name", "sdn_type", "program", "title", "call_sign", "vessel_type", "tonnage", "grt", "flag", "owner", "remarks")


def read_sdn(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 12-column file -> id, name, sdn_type, program, remarks; unusable rows dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _SDN_COLUMNS])
    raw = spark.read.schema(schema).csv(path, quote='"', escape='"', multiLine=False, mode="PERMISSIVE",
                                        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    def opt(c: str) -> Column:
        return F.when(~F.trim(c).isin("", "-0-"), F.trim(c)).alias(c)

    return raw.filter((F.coalesce(F.trim("name"), F.lit("")) != "") & (F.upper(F.trim("name")) != "SDN_NAME")).select(
        F.trim("id").alias("id"), F.trim("name").alias("name"), opt("sdn_type"), opt("program"), opt("remarks"))


def _reorder(name: Column) -> Column:
    """"LAST, First Middle" -> "First Middle LAST"."""
    last, first = F.substring_index(name, ",", 1), F.regexp_extract(name, r"^[^,]*,(.*)$", 1)
    return F.when(F.contains(name, F.lit(",")), F.trim(F.concat(F.trim(first), F.lit(" "), F.trim(last)))).otherwise(F.trim(name))


def parse_ofac(entries: DataFrame) -> DataFrame:
    """Individuals of an SDN scan with the attributes of their remarks."""
    people = entries.filter(F.lower(F.coalesce("sdn_type", F.lit(""))) == "individual")
    parts = F.filter(F.transform(F.split(F.coalesce("remarks", F.lit("")), ";"),
                                 lambda p: F.trim(F.regexp_replace(F.trim(p), r"\.+$", ""))), lambda p: p != "")
    people = people.withColumn("_p", parts)
    low = F.lower

    def pick(test, value) -> Column:
        return F.transform(F.filter("_p", test), value)

    dobs = pick(lambda p: low(p).rlike(r"^(alt\. )?dob "), lambda p: ofac_dob(F.regexp_replace(p, r"(?i)^(alt\. )?dob", "")))
    pobs = pick(lambda p: low(p).startswith("pob "), lambda p: F.trim(p.substr(5, 100000)))
    nats = pick(lambda p: low(p).rlike(r"^(alt\. )?(nationality|citizen) "),
                lambda p: F.trim(F.regexp_replace(p, r"(?i)^(alt\. )?(nationality|citizen) ", "")))
    gender = F.try_element_at(pick(lambda p: low(p).startswith("gender "), lambda p: F.trim(p.substr(8, 100000))), F.lit(-1))

    def doc(prefix: str, kind: str) -> Column:
        pattern = rf"^{prefix}\s+(\S+)(?:\s+\(([^)]+)\))?"
        def build(p: Column) -> Column:
            number = F.regexp_replace(F.regexp_extract(p, pattern, 1), r"[.,]+$", "")
            return F.when(p.rlike(pattern), document(kind, number, F.nullif(F.regexp_extract(p, pattern, 2), F.lit(""))))
        return build

    docs = F.transform("_p", lambda p: F.coalesce(
        doc("Passport", "passport")(p), doc(r"National ID No\.", "national_id")(p)))
    alias = r"(?i)^([af])\.k\.a\.\s+'([^']+)'"
    aliases = pick(lambda p: p.rlike(alias), lambda p: person_name(
        _reorder(F.regexp_extract(p, alias, 2)), F.when(low(F.regexp_extract(p, alias, 1)) == "f", "fka").otherwise("aka")))
    primary = _reorder(F.col("name"))
    return _persons(people.select(
        F.col("id").alias("source_entry_id"), primary.alias("primary_name"),
        F.concat(F.array(person_name(F.col("name"), "primary"), person_name(primary, "primary")), aliases).alias("names"),
        dobs.alias("dobs"), pobs.alias("pobs"), nats.alias("nationalities"), docs.alias("documents"), gender.alias("gender"), "program",
    ), "ofac_sdn")


def read_ofac(spark: SparkSession, path: str) -> DataFrame:
    return parse_ofac(read_sdn(spark, path))


# --- UN -------------------------------------------------------------------------------------

UN_SCHEMA = (
    "DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, UN_LIST_TYPE string, "
    "NAME_ORIGINAL_SCRIPT string, GENDER string, NATIONALITY array<struct<VALUE:array<string>>>, "
    "INDIVIDUAL_ALIAS array<struct<QUALITY:string,ALIAS_NAME:string>>, "
    "INDIVIDUAL_DATE_OF_BIRTH array<struct<TYPE_OF_DATE:string,DATE:string,YEAR:string,FROM_YEAR:string,TO_YEAR:string>>, "
    "INDIVIDUAL_PLACE_OF_BIRTH array<struct<CITY:string,COUNTRY:string>>, "
    "INDIVIDUAL_DOCUMENT array<struct<TYPE_OF_DOCUMENT:string,NUMBER:string,ISSUING_COUNTRY:string,COUNTRY_OF_ISSUE:string>>")


def read_un(spark: SparkSession, path: str) -> DataFrame:
    """Consolidated XML, one row per INDIVIDUAL; the file is split by row tag across tasks."""
    raw = spark.read.format("xml").option("rowTag", "INDIVIDUAL").schema(UN_SCHEMA).load(path)

    def joined(sep: str, *parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), sep)

    primary = joined(" ", *[blank(F.col(c)) for c in ("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME")])

    def birth(d: Column) -> Column:
        kind = F.upper(F.coalesce(blank(d["TYPE_OF_DATE"]), F.lit("")))
        circa = F.when(kind == "APPROXIMATELY", F.lit(True))
        lo, hi, day, year = year_of(d["FROM_YEAR"]), year_of(d["TO_YEAR"]), blank(d["DATE"]), year_of(d["YEAR"])
        return (F.when(kind == "BETWEEN", F.when(lo.isNotNull() & hi.isNotNull(), dob(from_year=lo, to_year=hi)))
                .when(day.isNotNull(), dob(date=F.substring(day, 1, 10), circa=circa))
                .when(year.isNotNull(), dob(year=year, circa=circa)))

    def doc(d: Column) -> Column:
        raw_type = F.lower(F.coalesce(blank(d["TYPE_OF_DOCUMENT"]), F.lit("other")))
        kind = (F.when(raw_type == "passport", "passport")
                .when(raw_type.isin("national identification number", "national identity card"), "national_id")
                .otherwise(F.replace(raw_type, F.lit(" "), F.lit("_"))))
        country = F.coalesce(blank(d["ISSUING_COUNTRY"]), blank(d["COUNTRY_OF_ISSUE"]))
        return F.when(blank(d["NUMBER"]).isNotNull(), document(kind, blank(d["NUMBER"]), country))

    original = blank(F.col("NAME_ORIGINAL_SCRIPT"))
    names = F.concat(
        F.array(person_name(primary, "primary"), F.when(original.isNotNull(), person_name(original, "original", script="original"))),
        F.transform(F.coalesce("INDIVIDUAL_ALIAS", F.array().cast("array<struct<QUALITY:string,ALIAS_NAME:string>>")),
                    lambda a: F.when(blank(a["ALIAS_NAME"]).isNotNull(), person_name(
                        blank(a["ALIAS_NAME"]), "aka", quality=F.lower(F.coalesce(blank(a["QUALITY"]), F.lit("")))))))
    return _persons(raw.select(
        F.coalesce(blank(F.col("DATAID")), F.lit("")).alias("source_entry_id"), primary.alias("primary_name"), names.alias("names"),
        F.transform("INDIVIDUAL_DATE_OF_BIRTH", birth).alias("dobs"),
        F.transform("INDIVIDUAL_PLACE_OF_BIRTH", lambda p: joined(", ", blank(p["CITY"]), blank(p["COUNTRY"]))).alias("pobs"),
        F.flatten(F.transform("NATIONALITY", lambda n: F.transform(n["VALUE"], lambda v: F.trim(v)))).alias("nationalities"),
        F.transform("INDIVIDUAL_DOCUMENT", doc).alias("documents"), blank(F.col("GENDER")).alias("gender"),
        blank(F.col("UN_LIST_TYPE")).alias("program"),
    ), "un_consolidated")


# --- EU -------------------------------------------------------------------------------------

EU_SCHEMA = (
    "_logicalId string, subjectType struct<_code:string>, regulation array<struct<_programme:string>>, "
    "nameAlias array<struct<_wholeName:string,_gender:string,_nameLanguage:string,_strong:string>>, "
    "birthdate array<struct<_birthdate:string,_year:string,_monthOfYear:string,_yearRangeFrom:string,_yearRangeTo:string,"
    "_circa:string,_city:string,_countryIso2Code:string>>, citizenship array<struct<_countryIso2Code:string>>, "
    "identification array<struct<_identificationTypeCode:string,_number:string,_countryIso2Code:string>>")


def read_eu(spark: SparkSession, path: str) -> DataFrame:
    """Namespaced attribute XML; persons only, the first alias is the primary name."""
    raw = (spark.read.format("xml").option("rowTag", "sanctionEntity").option("ignoreNamespace", "true")
           .schema(EU_SCHEMA).load(path))
    none = F.lit("")

    def text(c: Column) -> Column:
        return F.nullif(c, none)

    def country(c: Column) -> Column:
        return F.when(~F.coalesce(c, none).isin("", "00"), c)

    aliases = F.filter("nameAlias", lambda a: text(a["_wholeName"]).isNotNull())
    people = raw.withColumn("_a", aliases).filter((F.col("subjectType._code") == "person") & (F.size("_a") > 0))

    def birth(b: Column) -> Column:
        circa = F.when(b["_circa"] == "true", F.lit(True))
        lo, hi, year = year_of(b["_yearRangeFrom"]), year_of(b["_yearRangeTo"]), year_of(b["_year"])
        month = F.when(b["_monthOfYear"].rlike(r"^\d{1,4}$"), b["_monthOfYear"].try_cast("int"))
        return (F.when(text(b["_birthdate"]).isNotNull(), dob(date=F.substring(b["_birthdate"], 1, 10), circa=circa))
                .when(lo.isNotNull() & hi.isNotNull(), dob(from_year=lo, to_year=hi, circa=circa))
                .when(year.isNotNull(), dob(year=year, month=F.when(month.between(1, 12), month), circa=circa)))

    def doc(d: Column) -> Column:
        code = F.lower(F.coalesce(text(d["_identificationTypeCode"]), F.lit("other")))
        kind = (F.when(code == "id", "national_id").when(code.isin("fiscalcode", "taxid"), "tax_id").otherwise(code))
        return F.when(text(d["_number"]).isNotNull(), document(kind, d["_number"], country(d["_countryIso2Code"])))

    first = F.element_at("_a", 1)
    programmes = F.filter(F.transform("regulation", lambda r: text(r["_programme"])), lambda p: p.isNotNull())
    return _persons(people.select(
        F.coalesce("_logicalId", none).alias("source_entry_id"), first["_wholeName"].alias("primary_name"),
        F.transform("_a", lambda a, i: person_name(
            a["_wholeName"], F.when(i == 0, "primary").otherwise("aka"),
            quality=F.when(a["_strong"] == "false", "low"), language=text(a["_nameLanguage"]))).alias("names"),
        F.transform("birthdate", birth).alias("dobs"),
        F.transform("birthdate", lambda b: F.array_join(F.filter(F.array(text(b["_city"]), country(b["_countryIso2Code"])),
                                                                 lambda p: p.isNotNull()), ", ")).alias("pobs"),
        F.transform("citizenship", lambda c: country(c["_countryIso2Code"])).alias("nationalities"),
        F.transform("identification", doc).alias("documents"), text(first["_gender"]).alias("gender"),
        F.try_element_at(programmes, F.lit(1)).alias("program"),
    ), "eu_fsf")


# --- UK -------------------------------------------------------------------------------------

def read_uk(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a preamble line; rows of one group merge into one person, primary names first.

    A group is one listed person with a few alias rows, so the per-group list stays short.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "^﻿", "").alias("value"), F.monotonically_increasing_id().alias("_line"))
    header_line = (lines.filter(~F.col("value").startswith("Last Updated")).orderBy("_line").select("value").first())
    if header_line is None:
        raise ValueError("the file is empty")
    header = [h.strip() for h in _csv_fields(header_line[0])]
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    body = lines.filter(~F.col("value").startswith("Last Updated") & (F.col("value") != header_line[0]))
    rows = body.select("_line", F.from_csv("value", ", ".join(f"`{h}` STRING" for h in schema.names),
                                           {"quote": '"', "escape": '"'}).alias("r")).select("_line", "r.*")

    def col(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in header else F.lit("")

    def joined(sep: str, *parts: Column) -> Column:
        return F.trim(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), sep))

    full = joined(" ", *[col(f"Name {i}") for i in range(1, 7)])
    alias = F.lower(col("Alias Type"))
    kind = (F.when(alias == "primary name", "primary").when(alias == "primary name variation", "variation")
            .when(alias == "fka", "fka").otherwise("aka"))
    original = col("Name Non-Latin Script")
    quality = F.nullif(F.lower(col("Alias Quality")), F.lit(""))
    row = F.struct(
        F.when(F.col("`Alias Type`") == "Primary name", 0).otherwise(1).alias("rank"), F.col("_line").alias("line"),
        full.alias("full"), F.nullif(col("Regime"), F.lit("")).alias("regime"),
        F.array(person_name(full, kind, quality=quality),
                F.when(original != "", person_name(original, "original", script="original"))).alias("names"),
        F.transform(numbered(col("DOB")), uk_dob).alias("dobs"),
        joined(", ", col("Town of Birth"), col("Country of Birth")).alias("pob"),
        numbered(col("Nationality")).alias("nats"),
        F.concat(F.transform(numbered(col("Passport Number")), lambda n: document("passport", n)),
                 F.transform(numbered(col("National Identification Number")), lambda n: document("national_id", n))).alias("docs"))
    people = rows.filter(col("Group Type") == "Individual").select(col("Group ID").alias("source_entry_id"), row.alias("row"))
    grouped = people.groupBy("source_entry_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def every(field: str) -> Column:
        return F.flatten(F.transform("rows", lambda r: r[field]))

    first = F.element_at("rows", 1)
    return _persons(grouped.select(
        "source_entry_id", first["full"].alias("primary_name"), every("names").alias("names"), every("dobs").alias("dobs"),
        F.transform("rows", lambda r: r["pob"]).alias("pobs"), every("nats").alias("nationalities"), every("docs").alias("documents"),
        F.lit(None).cast("string").alias("gender"), first["regime"].alias("program"),
    ), "uk_ofsi")


def _csv_fields(line: str) -> list[str]:
    import csv

    return next(csv.reader([line]))


# --- federal exclusions ---------------------------------------------------------------------

EXCLUSION_COLUMNS = (
    "Classification", "Name", "First", "Last", "City", "State / Province", "Country", "Unique Entity ID", "Exclusion Program",
    "Excluding Agency", "Exclusion Type", "Active Date", "Termination Date", "Cross-Reference", "SAM Number", "CAGE",
)


def _day(c: Column) -> Column:
    return F.coalesce(F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(c, F.lit("MM/dd/yyyy"))))


def read_exclusions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(usable records, unusable rows) of an unzipped extract; a missing column is an error."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    names = [c.lstrip("﻿") for c in raw.columns]
    raw = raw.toDF(*names)
    missing = [c for c in EXCLUSION_COLUMNS if c not in names]
    if missing:
        raise ValueError("extract is missing columns: " + ", ".join(missing))

    def get(name: str) -> Column:
        return F.trim(F.replace(F.coalesce(F.col(f"`{name}`"), F.lit("")), F.lit("\u0000"), F.lit("")))

    person = F.array_join(F.filter(F.array(get("First"), get("Last")), lambda p: p != ""), " ")
    display = F.when(get("Name") != "", get("Name")).otherwise(person)
    end = get("Termination Date")
    rows = raw.select(
        get("SAM Number").alias("sam_number"), get("Classification").alias("classification"), get("Name").alias("name"),
        get("First").alias("first"), get("Last").alias("last"), core_name(display).alias("core_name"), get("City").alias("city"),
        get("State / Province").alias("state"), get("Country").alias("country"), get("Unique Entity ID").alias("uei"),
        get("CAGE").alias("cage"), get("Exclusion Program").alias("exclusion_program"),
        get("Excluding Agency").alias("excluding_agency"), get("Exclusion Type").alias("exclusion_type"),
        _day(get("Active Date")).alias("active_date"), _day(end).alias("termination_date"),
        (F.lower(end) == "indefinite").alias("termination_indefinite"), get("Cross-Reference").alias("cross_reference"))
    usable = (F.col("core_name") != "") & (F.col("sam_number") != "")
    return rows.filter(usable), rows.filter(~usable)
