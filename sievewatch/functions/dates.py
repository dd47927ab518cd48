"""Partial-date parsing for subjects and list files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOB_TYPE = "struct<date:string,year:int,month:int,circa:boolean,from_year:int,to_year:int>"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def dob(date=None, year=None, month=None, circa=None, from_year=None, to_year=None) -> Column:
    """Build one list birth date; an absent key is NULL."""
    def part(value, kind):
        return (F.lit(None) if value is None else value).cast(kind)

    return F.struct(
        part(date, "string").alias("date"), part(year, "int").alias("year"),
        part(month, "int").alias("month"), part(circa, "boolean").alias("circa"),
        part(from_year, "int").alias("from_year"), part(to_year, "int").alias("to_year"),
    )


def partial_date(c: Column) -> Column:
    """``YYYY[-MM[-DD]]`` -> struct<y,m,d>; anything else NULL."""
    v = F.trim(c)
    pattern = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(v, pattern, i), F.lit("")).cast("int")

    return F.when(
        v.rlike(pattern), F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))
    )


def year_of(c: Column) -> Column:
    """A bare four-digit year, NULL for blanks and junk."""
    return F.when(F.trim(c).rlike(r"^\d{4}$"), F.trim(c).cast("int"))


def _real_date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"),
                       F.lpad(d.cast("string"), 2, "0"))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def ofac_dob(c: Column) -> Column:
    """"[circa ]d Mon yyyy | Mon yyyy | yyyy | yyyy to yyyy" -> birth date, else NULL."""
    text = F.trim(c)
    circa = F.lower(text).startswith("circa ")
    t = F.trim(F.regexp_replace(text, r"(?i)^circa ", ""))
    span, full, month_year, year = (
        r"^(\d{4})\s+to\s+(\d{4})$", r"^(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})$",
        r"^([A-Za-z]{3})\s+(\d{4})$", r"^(\d{4})$",
    )

    def month(i: int, pattern: str) -> Column:
        names = F.array(*[F.lit(m) for m in _MONTHS])
        return F.nullif(F.array_position(names, F.lower(_group(t, pattern, i))).cast("int"), F.lit(0))

    fuzzy = F.when(circa, F.lit(True))
    y, m, d = _group(t, full, 3).cast("int"), month(2, full), _group(t, full, 1).cast("int")
    exact = _real_date(y, m, d)
    return (
        F.when(t.rlike(span), dob(from_year=_group(t, span, 1), to_year=_group(t, span, 2)))
        .when(t.rlike(full) & m.isNotNull(),
              F.when(exact.isNotNull(), dob(date=exact)).otherwise(dob(year=y, month=m)))
        .when(t.rlike(month_year) & month(1, month_year).isNotNull(),
              dob(year=_group(t, month_year, 2), month=month(1, month_year), circa=fuzzy))
        .when(t.rlike(year), dob(year=_group(t, year, 1), circa=fuzzy))
    )


def uk_dob(c: Column) -> Column:
    """``dd/mm/yyyy`` with 00 parts -> date, year+month or year; other shapes NULL."""
    pattern = r"^(\d{2})/(\d{2})/(\d{4})$"
    t = F.trim(c)
    d, m, y = (_group(t, pattern, i).cast("int") for i in (1, 2, 3))
    exact = _real_date(y, m, d)
    return F.when(
        t.rlike(pattern),
        F.when(~m.between(1, 12), dob(year=y))
        .when(exact.isNotNull(), dob(date=exact))
        .otherwise(dob(year=y, month=m)),
    )


def dob_compatible(a: Column, b: Column) -> Column:
    """Missing, or one a prefix of the other ("1968" and "1968-02-14")."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (x == "") | (y == "") | x.startswith(y) | y.startswith(x)


def iso_day(c: Column) -> Column:
    return F.nullif(F.substring(c.cast("string"), 1, 10), F.lit(""))
