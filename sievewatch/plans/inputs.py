"""Screening tables derived from the driver tables, in Spark and in SQL.

Subjects come from ``customer`` and list records from ``part``, so both grow with the
data. Names are fictional and combined by key arithmetic, which gives hot given names,
spelling variants, nicknames, particles and initials. Each block of ``NAME_BLOCK`` keys has
its own endings, so the vocabulary grows with the keys and matches per subject stay bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewatch.functions.dates import dob
from sievewatch.functions.names import NICKNAMES, PARTICLES
from sievewatch.plans.base import dealt, pick, sql_list, sql_pick, table

GIVEN = ("William", "Bill", "Robert", "Bob", "Katherine", "Kate", "Aleksandr", "Sasha", "Yusuf", "Yousuf", "Mikhail", "Misha",
         "Ivan", "Vanya", "Giuseppe", "Pino", "Mohammed", "Muhamad", "Philip", "Fillip", "Elena", "Yelena", "Sergei", "Seryozha")
FAMILY = ("Harrow", "Stonebridge", "Petrovsky", "Petrowski", "Al-Karim", "Karimov", "Volkov", "Wolkow", "Ksenakis", "Xenakis",
          "Phelan", "Felan", "Okafor", "Haddad", "Khadad", "Lindqvist", "Lindkvist", "Moreau", "Moro", "Castellan", "Kastelan",
          "Nakamura", "Oyelaran", "Bergstrom", "Quillon", "Killon", "Zaharenko", "Zakharenko", "Jankovic", "Yankovich", "Delacroix",
          "van der Meer", "Ibn Salah", "Salah", "Tarkas", "Tarkash", "Umarov", "Omarov", "Verhoeven", "Wright")
MIDDLE = ("James", "Ali", "Maria", "Jan", "Lee", "Noor", "Quinn")
ISO = ("US", "GB", "DE", "FR", "RU", "IR", "KP", "SY", "CN", "BR")
COUNTRY_TEXT = ("United States", "Great Britain", "Germany", "France", "Russian Federation", "Iran (Islamic Republic of)",
                "Korea, North", "Syrian Arab Republic", "China", "Brazil", "Ruritania")
COUNTRY_CODE = (*ISO, "ruritania")
CITIES = ("Arden", "Belmora", "Corvin", "Dunmere", "Eastvale")
NAME_BLOCK = 400


#: Every so many keys, a name of the first block: the share of very common names, which stays the same at any size.
COMMON = 50


def grown(name: Column, k: Column, common: int | None = None) -> Column:
    """The name with the ending of the key's block; the first block has none, nor has one key in ``common``."""
    code = F.regexp_replace(F.translate(F.floor(k / NAME_BLOCK).cast("string"), "0123456789", "bdfklmnrsj"), "(.)", "$1a")
    first = (k < NAME_BLOCK) if common is None else (k < NAME_BLOCK) | (k % common == 0)
    return F.when(first, name).otherwise(F.concat(name, code))


def sql_grown(name: str, k: str) -> str:
    return f"(CASE WHEN {k} < {NAME_BLOCK} THEN {name} ELSE {name} || regexp_replace(translate(({k} // {NAME_BLOCK})::VARCHAR, '0123456789', 'bdfklmnrsj'), '(.)', '\\1a', 'g') END)"


def subjects(spark: SparkSession, sf_dir: str, df: DataFrame | None = None, common: int | None = None) -> DataFrame:
    """subject_id, name, aliases, dob, nationality, pob, documents from ``customer``."""
    k = F.col("c_custkey")
    given, family = grown(pick(GIVEN, k % 24), k, common), grown(pick(FAMILY, (k * 7 + 3) % 40), k, common)
    iso = pick(ISO, F.col("c_nationkey") % 10)
    y, m, d = 1950 + k % 40, k % 12 + 1, k % 28 + 1
    day = F.format_string("%04d-%02d-%02d", y, m, d)
    birth = F.when(k % 4 == 0, day).when(k % 4 == 1, F.substring(day, 1, 7)).when(k % 4 == 2, F.substring(day, 1, 4))
    extra = F.filter(F.array(
        F.when(k % 5 == 0, F.concat(family, F.lit(" "), given)),
        F.when(k % 11 == 0, F.concat(F.substring(given, 1, 1), F.lit(". "), family))), lambda a: a.isNotNull())
    doc = F.struct(F.when(k % 2 == 0, "passport").otherwise("national_id").alias("type"),
                   F.concat(F.lit("P"), (k % 500).cast("string"), F.lit("-X")).alias("number"), iso.alias("country"))
    return (dealt(table(spark, sf_dir, "customer"), "c_custkey") if df is None else df).select(
        k.alias("subject_id"), F.concat(given, F.lit(" "), family).alias("name"), extra.alias("aliases"), birth.alias("dob"),
        iso.alias("nationality"), F.when(k % 6 < 5, pick(CITIES, k % 6)).alias("pob"),
        F.filter(F.array(F.when(k % 3 == 0, doc)), lambda x: x.isNotNull()).alias("documents"))


def records(spark: SparkSession, sf_dir: str, df: DataFrame | None = None, common: int | None = None) -> DataFrame:
    """record_id, names, dobs, pobs, nationalities, documents from ``part``."""
    k = F.col("p_partkey")
    given, family, middle = grown(pick(GIVEN, (k * 5 + 1) % 24), k, common), grown(pick(FAMILY, (k * 11 + 2) % 40), k, common), pick(MIDDLE, k % 7)
    space = F.lit(" ")
    names = F.filter(F.array(
        F.concat(family, F.lit(", "), given), F.concat(given, space, middle, space, family),
        F.when(k % 7 == 0, F.concat(F.substring(given, 1, 1), F.lit(". "), family))), lambda n: n.isNotNull())
    day = F.format_string("%04d-%02d-%02d", 1950 + k % 40, k % 12 + 1, k % 28 + 1)
    dobs = F.filter(F.array(
        F.when(k % 3 == 0, dob(date=day)),
        F.when(k % 3 == 1, dob(year=1950 + k % 40, month=F.when(k % 5 == 0, k % 12 + 1), circa=F.when(k % 2 == 0, F.lit(True)))),
        F.when((k % 3 == 2) & (k % 4 != 0), dob(from_year=1948 + k % 40, to_year=1952 + k % 40)),
        F.when(k % 9 == 0, dob(year=1951 + k % 40))), lambda x: x.isNotNull())
    doc = F.struct(F.lit("passport").alias("type"), F.concat(F.lit("p"), (k % 500).cast("string"), F.lit("x")).alias("number"),
                   pick(ISO, k % 10).alias("country"))
    return (dealt(table(spark, sf_dir, "part"), "p_partkey") if df is None else df).select(
        F.concat(F.lit("W"), k.cast("string")).alias("record_id"), names.alias("names"), dobs.alias("dobs"),
        F.array(F.concat(pick(CITIES, k % 5), F.lit(", Ruritania"))).alias("pobs"),
        F.filter(F.array(F.when(k % 8 != 0, pick(COUNTRY_TEXT, k % 11))), lambda x: x.isNotNull()).alias("nationalities"),
        F.filter(F.array(F.when(k % 2 == 0, doc)), lambda x: x.isNotNull()).alias("documents"))


_NICK = ", ".join(f"('{a}', '{b}')" for a, b in NICKNAMES.items())
_COLLAPSE = "translate(replace(replace(replace(f, 'ks', 'x'), 'kh', 'h'), 'ph', 'f'), 'yjqc', 'iikk')"
for _letter in "abcdefghijklmnopqrstuvwxyz0123456789":
    _COLLAPSE = f"regexp_replace({_COLLAPSE}, '{_letter}{_letter}+', '{_letter}', 'g')"
_V, _FR = "('a','e','i','o','u')", "('e','i','y')"
_SIB = "(n1 = 'i' AND n2 IN ('o','a'))"
_LETTER = f"""CASE
 WHEN ch = n1 AND ch <> 'c' THEN ''
 WHEN ch = 'h' AND p1 IN ('c','p','s','t') THEN ''
 WHEN ch = 'h' AND p1 = 'g' AND n1 NOT IN {_V} THEN ''
 WHEN ch = 'h' AND p1 = 'w' AND i = 2 THEN ''
 WHEN ch = 'g' AND p1 = 'd' AND n1 IN {_FR} THEN ''
 WHEN ch = 'y' AND (p1 = 'c' OR (p1 = 'g' AND p2 = 'd')) THEN ''
 WHEN ch IN {_V} THEN CASE WHEN i = 1 THEN ch ELSE '' END
 WHEN ch IN ('f','j','l','m','n','r') THEN ch
 WHEN ch = 'b' THEN CASE WHEN p1 = 'm' AND n1 = '' THEN '' ELSE 'b' END
 WHEN ch = 'c' THEN CASE WHEN (n1 = 'i' AND n2 = 'a') OR n1 = 'h' THEN 'x' WHEN n1 IN {_FR} THEN 's' ELSE 'k' END
 WHEN ch = 'd' THEN CASE WHEN n1 = 'g' AND n2 IN {_FR} THEN 'j' ELSE 't' END
 WHEN ch = 'g' THEN CASE WHEN n1 IN {_FR} THEN 'j' WHEN n1 = 'h' AND n2 NOT IN {_V} THEN '' ELSE 'k' END
 WHEN ch = 'h' THEN CASE WHEN i = 1 OR n1 IN {_V} OR p1 NOT IN {_V} THEN 'h' ELSE '' END
 WHEN ch = 'k' THEN CASE WHEN i = 1 OR p1 <> 'c' THEN 'k' ELSE '' END
 WHEN ch = 'p' THEN CASE WHEN n1 = 'h' THEN 'f' ELSE 'p' END
 WHEN ch = 'q' THEN 'k'
 WHEN ch = 's' THEN CASE WHEN n1 = 'h' OR {_SIB} THEN 'x' ELSE 's' END
 WHEN ch = 't' THEN CASE WHEN {_SIB} THEN 'x' WHEN n1 = 'h' THEN '0' WHEN n1 = 'c' AND n2 = 'h' THEN '' ELSE 't' END
 WHEN ch = 'v' THEN 'f'
 WHEN ch = 'w' THEN CASE WHEN i = 1 AND n1 = 'h' THEN CASE WHEN n2 IN {_V} OR n2 = '' THEN 'w' ELSE '' END
                         WHEN n1 IN {_V} OR n1 = '' THEN 'w' ELSE '' END
 WHEN ch = 'x' THEN CASE WHEN i = 1 THEN CASE WHEN n1 = 'h' OR {_SIB} THEN 'x' ELSE 's' END ELSE 'ks' END
 WHEN ch = 'y' THEN CASE WHEN n1 IN {_V} THEN 'y' ELSE '' END
 WHEN ch = 'z' THEN 's'
 ELSE '' END"""

# subj / svar: subjects and their name variants; rec / rvar: records and theirs.
PEOPLE_SQL = f"""
subj AS (
  SELECT k AS subject_id, given || ' ' || family AS name, given, family,
         CASE k % 4 WHEN 0 THEN day WHEN 1 THEN substr(day, 1, 7) WHEN 2 THEN substr(day, 1, 4) END AS dob,
         1950 + k % 40 AS y, CASE WHEN k % 4 < 2 THEN k % 12 + 1 END AS m, CASE WHEN k % 4 = 0 THEN k % 28 + 1 END AS d, k % 4 < 3 AS has_dob,
         iso AS nationality, CASE WHEN k % 6 < 5 THEN {sql_pick(CITIES, 'k % 6')} END AS pob,
         k % 3 = 0 AS has_doc, CASE WHEN k % 2 = 0 THEN 'passport' ELSE 'national_id' END AS doc_type,
         'P' || (k % 500) || 'X' AS doc_key, iso AS doc_country
  FROM (SELECT c_custkey AS k, {sql_grown(sql_pick(GIVEN, 'c_custkey % 24'), 'c_custkey')} AS given, {sql_grown(sql_pick(FAMILY, '(c_custkey * 7 + 3) % 40'), 'c_custkey')} AS family,
               {sql_pick(ISO, 'c_nationkey % 10')} AS iso,
               printf('%04d-%02d-%02d', 1950 + c_custkey % 40, c_custkey % 12 + 1, c_custkey % 28 + 1) AS day FROM customer)),
svar AS (
  SELECT subject_id, 0 AS vpos, name AS vname FROM subj
  UNION ALL SELECT subject_id, 1, family || ' ' || given FROM subj WHERE subject_id % 5 = 0
  UNION ALL SELECT subject_id, 2, substr(given, 1, 1) || '. ' || family FROM subj WHERE subject_id % 11 = 0),
rec AS (
  SELECT 'W' || k AS record_id, k, given, family, middle, {sql_pick(CITIES, 'k % 5')} || ', Ruritania' AS pob,
         CASE WHEN k % 8 <> 0 THEN {sql_pick(COUNTRY_CODE, 'k % 11')} END AS country, k % 2 = 0 AS has_doc,
         'P' || (k % 500) || 'X' AS doc_key, {sql_pick(ISO, 'k % 10')} AS doc_country
  FROM (SELECT p_partkey AS k, {sql_grown(sql_pick(GIVEN, '(p_partkey * 5 + 1) % 24'), 'p_partkey')} AS given, {sql_grown(sql_pick(FAMILY, '(p_partkey * 11 + 2) % 40'), 'p_partkey')} AS family,
               {sql_pick(MIDDLE, 'p_partkey % 7')} AS middle FROM part)),
rvar AS (
  SELECT record_id, 0 AS vpos, family || ', ' || given AS vname FROM rec
  UNION ALL SELECT record_id, 1, given || ' ' || middle || ' ' || family FROM rec
  UNION ALL SELECT record_id, 2, substr(given, 1, 1) || '. ' || family FROM rec WHERE k % 7 = 0),
rdob AS (
  SELECT record_id, 0 AS pos, 1950 + k % 40 AS dy, k % 12 + 1 AS dm, k % 28 + 1 AS dd, NULL::BIGINT AS year, NULL::BIGINT AS month, false AS circa,
         NULL::BIGINT AS lo, NULL::BIGINT AS hi, 'date' AS kind FROM rec WHERE k % 3 = 0
  UNION ALL SELECT record_id, 1, NULL, NULL, NULL, 1950 + k % 40, CASE WHEN k % 5 = 0 THEN k % 12 + 1 END, k % 2 = 0, NULL, NULL, 'year' FROM rec WHERE k % 3 = 1
  UNION ALL SELECT record_id, 2, NULL, NULL, NULL, NULL, NULL, false, 1948 + k % 40, 1952 + k % 40, 'range' FROM rec WHERE k % 3 = 2 AND k % 4 <> 0
  UNION ALL SELECT record_id, 3, NULL, NULL, NULL, 1951 + k % 40, NULL, false, NULL, NULL, 'year' FROM rec WHERE k % 9 = 0)"""

# The same people with a constant share of common names.
PEOPLE_COMMON_SQL = PEOPLE_SQL
for _key in ("c_custkey", "p_partkey"):
    PEOPLE_COMMON_SQL = PEOPLE_COMMON_SQL.replace(f"{_key} < {NAME_BLOCK} THEN", f"{_key} < {NAME_BLOCK} OR {_key} % {COMMON} = 0 THEN")

# ntok: tokens per name; tkey: keys per token; skey / rkey: keys per subject name token and per record.
KEYS_SQL = f"""
nick(a, b) AS (VALUES {_NICK}),
ntok AS (
  SELECT vname, list_filter(string_split(regexp_replace(lower(vname), '[^a-z0-9]+', ' ', 'g'), ' '),
                            lambda t: t <> '' AND NOT list_contains({sql_list(PARTICLES)}, t)) AS toks
  FROM (SELECT vname FROM svar UNION SELECT vname FROM rvar)),
tok AS (SELECT DISTINCT unnest(toks) AS t FROM ntok),
form AS (SELECT t, t AS f FROM tok UNION SELECT t, b FROM tok JOIN nick ON t = a),
word AS (SELECT DISTINCT f, CASE WHEN substr(f, 1, 2) IN ('kn','gn','pn','wr','ae') THEN substr(f, 2) ELSE f END AS w FROM form),
letter AS (SELECT f, i, substr(w, i, 1) AS ch, CASE WHEN i > 1 THEN substr(w, i - 1, 1) ELSE '' END AS p1,
                  CASE WHEN i > 2 THEN substr(w, i - 2, 1) ELSE '' END AS p2, substr(w, i + 1, 1) AS n1, substr(w, i + 2, 1) AS n2
           FROM (SELECT f, w, unnest(range(1, length(w) + 1)) AS i FROM word)),
mp AS (SELECT f, upper(string_agg({_LETTER}, '' ORDER BY i)) AS code FROM letter GROUP BY f),
sk AS (SELECT f, substr(c, 1, 1) || regexp_replace(substr(c, 2), '[aeiou]', '', 'g') AS code
       FROM (SELECT f, {_COLLAPSE} AS c FROM word)),
tkey AS (SELECT DISTINCT t, key FROM (
           SELECT t, 'sk:' || code AS key FROM form JOIN sk USING (f) WHERE length(t) > 1
           UNION ALL SELECT t, 'mp:' || code FROM form JOIN mp USING (f) WHERE length(t) > 1)),
skey AS (SELECT vname, pos, t, key FROM (SELECT vname, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM ntok
                                         WHERE vname IN (SELECT vname FROM svar)) JOIN tkey USING (t)),
rkey AS (SELECT DISTINCT record_id, key FROM (SELECT record_id, unnest(toks) AS t FROM rvar JOIN ntok USING (vname)) JOIN tkey USING (t))"""

# pairs: candidates per subject, all that share a key with one of its names.
PAIRS_SQL = """
ngroup AS (SELECT vname, count(DISTINCT pos) AS n FROM skey GROUP BY vname),
hit AS (SELECT vname, record_id, count(DISTINCT pos) AS n_pos FROM skey JOIN rkey USING (key) GROUP BY ALL),
kept AS (SELECT vname, record_id, n_pos = n AS is_full FROM hit JOIN ngroup USING (vname)),
pair AS (SELECT subject_id, record_id, bool_or(is_full) AS is_full FROM svar JOIN kept USING (vname) GROUP BY ALL)"""

# scored: every pair with its term names, score and band.
SCORE_SQL = """
eq AS (SELECT a.t, list(DISTINCT b.t) AS eqs FROM tkey a JOIN tkey b USING (key) GROUP BY a.t),
need AS (SELECT DISTINCT s.vname AS sname, r.vname AS rname FROM pair JOIN svar s USING (subject_id) JOIN rvar r USING (record_id)),
fold AS (
  SELECT sname, rname, a.toks AS stoks, b.toks AS unused, 1 AS pos, 0 AS matched, false AS ini
  FROM need JOIN ntok a ON a.vname = sname JOIN ntok b ON b.vname = rname
  UNION ALL
  SELECT sname, rname, stoks, CASE WHEN idx > 0 THEN list_concat(unused[1:idx - 1], unused[idx + 1:]) ELSE unused END,
         pos + 1, matched + (idx > 0)::INT, ini OR (fidx = 0 AND iidx > 0)
  FROM (SELECT *, CASE WHEN fidx > 0 THEN fidx ELSE iidx END AS idx FROM (
          SELECT fold.*, coalesce(list_position(list_transform(unused, lambda x: list_contains(coalesce(eqs, []), x)), true), 0) AS fidx,
                 coalesce(list_position(list_transform(unused, lambda x: (length(x) = 1 OR length(stoks[pos]) = 1)
                                                       AND substr(x, 1, 1) = substr(stoks[pos], 1, 1)), true), 0) AS iidx
          FROM fold LEFT JOIN eq ON eq.t = stoks[pos] WHERE pos <= len(stoks)))),
nrank AS (
  SELECT sname, rname, CASE WHEN len(stoks) = 0 OR len(b.toks) = 0 THEN NULL WHEN stoks = b.toks THEN 0
           WHEN list_sort(stoks) = list_sort(b.toks) THEN 1
           WHEN matched = len(stoks) AND len(stoks) >= 2 AND len(unused) <= 1 THEN CASE WHEN ini THEN 3 ELSE 2 END
           WHEN matched > 0 THEN 4 END AS rank
  FROM fold JOIN ntok b ON b.vname = rname WHERE pos = len(stoks) + 1),
pname AS (SELECT subject_id, record_id, min(rank) AS rank FROM pair JOIN svar s USING (subject_id) JOIN rvar r USING (record_id)
          JOIN nrank ON sname = s.vname AND rname = r.vname GROUP BY ALL),
pdob AS (
  SELECT subject_id, record_id, min(CASE
           WHEN kind = 'date' AND dy = y AND dm IS NOT DISTINCT FROM m AND dd IS NOT DISTINCT FROM d THEN 0
           WHEN kind = 'date' AND d IS NULL AND dy = y AND (m IS NULL OR dm = m) THEN 1
           WHEN kind = 'range' AND y BETWEEN lo AND hi THEN 2
           WHEN kind = 'year' AND circa AND abs(year - y) <= 2 THEN 2
           WHEN kind = 'year' AND NOT circa AND year = y AND (month IS NULL OR m IS NULL OR month = m) THEN 1 END) AS rank,
         bool_or(kind = 'date') AND max(d) IS NOT NULL AS both_full
  FROM pair JOIN subj USING (subject_id) JOIN rdob USING (record_id) WHERE has_dob GROUP BY ALL),
term AS (
  SELECT subject_id, record_id,
    CASE n.rank WHEN 0 THEN 'name_exact_normalized' WHEN 1 THEN 'name_token_reordered' WHEN 2 THEN 'name_translit_equivalent'
                WHEN 3 THEN 'name_initials_compatible' WHEN 4 THEN 'name_partial_overlap' END AS name_term,
    CASE WHEN d.subject_id IS NULL THEN NULL WHEN d.rank = 0 THEN 'dob_full_match' WHEN d.rank = 1 THEN 'dob_year_match'
         WHEN d.rank = 2 THEN 'dob_within_range' WHEN both_full THEN 'dob_conflict' ELSE 'dob_partial_conflict' END AS dob_term,
    CASE WHEN s.has_doc AND r.has_doc AND s.doc_type = 'passport' THEN
      CASE WHEN s.doc_key = r.doc_key THEN 'id_number_match' WHEN s.doc_country = r.doc_country THEN 'id_number_conflict' END END AS id_term,
    CASE WHEN r.country IS NOT NULL THEN CASE WHEN r.country = s.nationality THEN 'nationality_match' ELSE 'nationality_conflict' END END AS nat_term,
    CASE WHEN starts_with(r.pob, s.pob) THEN 'pob_match' END AS pob_term
  FROM pair JOIN subj s USING (subject_id) JOIN rec r USING (record_id)
  LEFT JOIN pname n USING (subject_id, record_id) LEFT JOIN pdob d USING (subject_id, record_id)),
freq AS (SELECT *, count(*) FILTER (WHERE name_term IN ('name_exact_normalized','name_token_reordered','name_translit_equivalent'))
                   OVER (PARTITION BY subject_id) AS name_frequency FROM term),
pen AS (SELECT *, CASE WHEN name_term IS NOT NULL AND name_frequency >= 10 AND coalesce(dob_term, '') NOT IN ('dob_full_match','dob_year_match','dob_within_range')
                        AND coalesce(id_term, '') <> 'id_number_match' THEN 'common_name_penalty' END AS pen_term FROM freq),
scored AS (
  SELECT *, round(
    CASE name_term WHEN 'name_exact_normalized' THEN 0.5 WHEN 'name_token_reordered' THEN 0.45 WHEN 'name_translit_equivalent' THEN 0.4
                   WHEN 'name_initials_compatible' THEN 0.35 WHEN 'name_partial_overlap' THEN 0.2 ELSE 0 END::DOUBLE
    + CASE dob_term WHEN 'dob_full_match' THEN 0.3 WHEN 'dob_year_match' THEN 0.15 WHEN 'dob_within_range' THEN 0.1
                    WHEN 'dob_conflict' THEN -0.35 WHEN 'dob_partial_conflict' THEN -0.15 ELSE 0 END::DOUBLE
    + CASE id_term WHEN 'id_number_match' THEN 0.6 WHEN 'id_number_conflict' THEN -0.3 ELSE 0 END::DOUBLE
    + CASE nat_term WHEN 'nationality_match' THEN 0.1 WHEN 'nationality_conflict' THEN -0.1 ELSE 0 END::DOUBLE
    + CASE WHEN pob_term IS NOT NULL THEN 0.05 ELSE 0 END::DOUBLE
    + CASE WHEN pen_term IS NOT NULL THEN -0.15 ELSE 0 END::DOUBLE, 6) AS score FROM pen),
banded AS (
  SELECT *, CASE WHEN score >= 0.9 THEN 'MATCH' WHEN score >= 0.35 OR (name_term IS NOT NULL AND name_term <> 'name_partial_overlap'
             AND (dob_term IN ('dob_conflict','dob_partial_conflict') OR id_term = 'id_number_conflict')) THEN 'REVIEW' ELSE 'CLEAR' END AS band,
         CASE WHEN score >= 0.9 THEN 'score_at_or_above_match' WHEN score >= 0.35 THEN 'between_thresholds'
              WHEN name_term IS NOT NULL AND name_term <> 'name_partial_overlap'
                   AND (dob_term IN ('dob_conflict','dob_partial_conflict') OR id_term = 'id_number_conflict') THEN 'conflict_floor'
              ELSE 'score_below_clear' END AS band_reason FROM scored),
decided AS (
  SELECT subject_id, coalesce(CASE max(CASE band WHEN 'MATCH' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END) WHEN 2 THEN 'MATCH' WHEN 1 THEN 'REVIEW' END, 'CLEAR') AS disposition,
         max(score) AS top_score, count(score) AS n_candidates, count(*) FILTER (WHERE band = 'MATCH') AS n_match,
         count(*) FILTER (WHERE band = 'REVIEW') AS n_review
  FROM subj LEFT JOIN banded USING (subject_id) GROUP BY subject_id)"""


def with_ctes(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n" + select
