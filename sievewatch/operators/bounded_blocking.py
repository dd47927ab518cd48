"""Candidates that can leave CLEAR, found without building all pairs that share a key.

Sharing one phonetic key says little: a common given name pairs a fixed share of all subjects with a fixed share of the
list, which grows with the product of both. Most of these pairs are CLEAR whatever else they hold. Here a pair is built
only if it meets under a composite key, and the composite keys are drawn from the rule so that no pair is lost whose band
is REVIEW or MATCH. Pairs that are left out are CLEAR for certain; what they add to a decision (that there were some) is
taken from the keys alone.

Why nothing is lost. A band above CLEAR needs a whole-name term (exact, reordered, equivalent, initials), or a score of
``clear_below`` from a partial overlap or no name term and other evidence.

* Exact and reordered names have the same sorted tokens: key ``n:`` and those.
* In the two other whole-name terms every subject token has a partner, and there are at least two. Take any two of them. Both
  have partners by key: they meet at ``kk:`` and one key of each. One has a partner by key, the other by initial: ``ki:``, the
  key and the initial, with a mark of which side is the initial, as two full tokens are no such pair. Both have partners by initial:
  ``ii:``, a blocking key, both initials and both marks.
* Otherwise the score is at most the partial weight plus the positive weights of the evidence that is there. Every least
  set of evidence kinds that reaches ``clear_below`` is turned into a key: a birth year (``kd:``), a document number
  (``kn:``), country and place (``kp:``), country (``kc:``) or place (``kl:``), each beside a blocking key. If no evidence is
  needed, the blocking key itself is the key (``k:``) and all pairs are built.

Tokens get their keys from a token dictionary, each distinct token once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewatch.functions.names import NORMALIZER_VERSION, name_tokens, token_keys
from sievewatch.operators.blocking import subject_variants
from sievewatch.operators.decision import rollup, subject_names, with_band, without_keys
from sievewatch.operators.pair_terms import prepare_records, prepare_subjects, score_pairs, spoken_names
from sievewatch.operators.rules import NAME_TERMS
from sievewatch.session import ensure_checkpoint_dir
from sievewatch.sources.sinks import table_exists

_KEYED = "array<struct<t:string,k:array<string>>>"
#: Kinds of evidence beside the name, with the terms that speak for a pair.
EVIDENCE = {
    "dob": ("dob_full_match", "dob_year_match", "dob_within_range"), "id": ("id_number_match",),
    "country": ("nationality_match",), "place": ("pob_match",),
}


def token_dictionary(names: DataFrame, path: str | None = None, phonetic: bool = True) -> DataFrame:
    """(token, keys): each distinct token of ``names`` (name_key) once.

    With ``path`` the dictionary is a stored table, one folder per normalizer version: only tokens it does not hold yet are
    keyed and added, so a later run over the same vocabulary keys nothing.
    """
    tokens = names.select(F.explode(F.split("name_key", " ")).alias("token")).where("token <> ''").distinct()
    keyed = token_keys(F.col("token"), phonetic).alias("keys")
    if path is None:
        return tokens.select("token", keyed)
    spark: SparkSession = names.sparkSession
    folder = f"{path.rstrip('/')}/normalizer={NORMALIZER_VERSION}{'' if phonetic else '-skeleton'}"
    if table_exists(spark, folder):
        tokens = tokens.join(spark.read.parquet(folder).select("token"), "token", "left_anti")
    tokens.select("token", keyed).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).dropDuplicates(["token"])  # two runs may have added a token at once


def keyed_names(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name_key, tokens): every distinct name with its tokens in order and their keys."""
    at = names.select("name_key").distinct().select("name_key", F.posexplode(F.split("name_key", " ")).alias("pos", "token"))
    held = at.join(dictionary, "token").groupBy("name_key")
    return held.agg(F.sort_array(F.collect_list(F.struct("pos", F.col("token").alias("t"), F.col("keys").alias("k")))).alias("_tokens")).select(
        "name_key", F.transform("_tokens", lambda x: F.struct(x["t"].alias("t"), x["k"].alias("k"))).alias("tokens"))


def least_evidence(rule: dict) -> list[tuple[str, ...]]:
    """Least sets of evidence kinds with which a partial overlap, or no name term at all, reaches ``clear_below``."""
    weights = rule["weights"]
    known = {*NAME_TERMS, *(t for terms in EVIDENCE.values() for t in terms)}
    base = max(0.0, weights.get("name_partial_overlap", 0.0)) + sum(max(0.0, w) for t, w in weights.items() if t not in known)
    best = {kind: max([0.0, *(weights.get(t, 0.0) for t in terms)]) for kind, terms in EVIDENCE.items()}
    found: list[tuple[str, ...]] = []
    for size in range(len(best) + 1):
        for kinds in combinations(best, size):
            reaches = base + sum(best[k] for k in kinds) >= rule["thresholds"]["clear_below"] - 1e-6
            if reaches and not any(set(f) <= set(kinds) for f in found):
                found.append(kinds)
    return found


def _cross(a: Column, b: Column, prefix: str) -> Column:
    """All ``prefix`` || x | y of two arrays."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(F.lit(prefix), x, F.lit("|"), y))))


def _sorted_pairs(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(F.lit("kk:"), F.least(x, y), F.lit("|"), F.greatest(x, y)))))


def _one(token: Column) -> Column:
    return F.length(token["t"]) == 1


def _name_keys(tokens: Column, all_keys: Column, subject: bool) -> Column:
    """Composite keys of one name. Marks name the list side's token: 1 an initial, 0 a full one; a subject asks for all that fit."""
    def marks(token: Column) -> Column:
        own = F.when(_one(token), "1").otherwise("0")
        if not subject:
            return F.array(own)
        return F.when(_one(token), F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("1")))

    def letters(token: Column) -> Column:
        return F.transform(marks(token), lambda m: F.concat(token["t"].substr(1, 1), m))

    def of_pair(a: Column, i: Column, b: Column, j: Column) -> Column:
        # two initials have no key of their own, so the pair meets beside a key of any name
        initials = F.flatten(F.transform(letters(a), lambda x: F.flatten(F.transform(letters(b), lambda y: F.transform(
            all_keys, lambda k: F.concat(F.lit("ii:"), F.least(x, y), F.lit("|"), F.greatest(x, y), F.lit("|"), k))))))
        once = F.when(i < j, F.concat(_sorted_pairs(a["k"], b["k"]), initials)).otherwise(F.array().cast("array<string>"))
        return F.concat(once, _cross(a["k"], letters(b), "ki:"))

    pairs = F.flatten(F.transform(tokens, lambda a, i: F.flatten(F.transform(
        tokens, lambda b, j: F.when(i != j, of_pair(a, i, b, j)).otherwise(F.array().cast("array<string>"))))))
    whole = F.concat(F.lit("n:"), F.array_join(F.array_sort(F.transform(tokens, lambda x: x["t"])), " "))
    return F.concat(F.when(F.size(tokens) > 0, F.array(whole)).otherwise(F.array().cast("array<string>")), F.coalesce(pairs, F.array().cast("array<string>")))


def _evidence_keys(sets: list[tuple[str, ...]], keys: Column, years: Column, numbers: Column, countries: Column, places: Column) -> Column:
    """Composite keys of each least set of evidence; one kind of a set is enough where it is rare."""
    both = F.flatten(F.transform(countries, lambda c: F.transform(places, lambda p: F.concat(c, F.lit("|"), p))))
    parts = []
    for kinds in sets:
        if not kinds:
            parts.append(F.transform(keys, lambda k: F.concat(F.lit("k:"), k)))
        elif "id" in kinds:
            parts.append(_cross(keys, numbers, "kn:"))
        elif "dob" in kinds:
            parts.append(_cross(keys, years, "kd:"))
        elif len(kinds) == 2:
            parts.append(_cross(keys, both, "kp:"))
        else:
            parts.append(_cross(keys, countries, "kc:") if kinds == ("country",) else _cross(keys, places, "kl:"))
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def _tokens_of(frame: DataFrame, key: str, keyed: DataFrame) -> DataFrame:
    """(key, forms: the keyed tokens of every name, keys: all their keys) of ``frame`` (key, name_key)."""
    held = frame.where("name_key <> ''").distinct().join(keyed, "name_key").groupBy(key).agg(F.collect_list("tokens").alias("forms"))
    keys = F.array_distinct(F.flatten(F.transform(F.flatten("forms"), lambda t: t["k"])))
    return held.withColumn("keys", keys)


def dictionary_forms(frame: DataFrame, key: str, names: Column, keyed: DataFrame) -> DataFrame:
    """(key, _forms): the names of a row in order, as ``name_forms`` gives them, with keys from the dictionary."""
    at = frame.select(key, F.posexplode(names).alias("pos", "name")).withColumn("name_key", F.array_join(name_tokens(F.col("name")), " "))
    form = F.struct("pos", "name", F.col("name_key").alias("key"), F.coalesce("tokens", F.array().cast(_KEYED)).alias("tokens"))
    held = at.join(keyed, "name_key", "left").groupBy(key).agg(F.sort_array(F.collect_list(form)).alias("_held"))
    return held.select(key, F.transform("_held", lambda x: x.dropFields("pos")).alias("_forms"))


def _name_table(frame: DataFrame, key: str, names: Column) -> DataFrame:
    return subject_variants(frame.select(F.col(key).alias("subject_id"), names.alias("names"))).withColumnRenamed("subject_id", key)


def all_keyed_names(subjects: DataFrame, records: DataFrame, phonetic: bool = True, dictionary_path: str | None = None) -> DataFrame:
    """``keyed_names`` of both sides; the dictionary is a table below the shared checkpoint folder unless a path is given."""
    rows = _name_table(subjects, "subject_id", subject_names(subjects)).select("name_key").unionAll(_name_table(records, "record_id", F.col("names")).select("name_key"))
    path = dictionary_path or f"{ensure_checkpoint_dir(subjects.sparkSession).rstrip('/')}/token-dictionary"
    return keyed_names(rows.distinct(), token_dictionary(rows, path, phonetic))


def composite_keys(subjects: DataFrame, records: DataFrame, rule: dict, keyed: DataFrame, phonetic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(subject_id, keys, composites) and (record_id, keys, composites)."""
    subject_rows, record_rows = _name_table(subjects, "subject_id", subject_names(subjects)), _name_table(records, "record_id", F.col("names"))
    sets = least_evidence(rule)
    empty = F.array().cast("array<string>")

    def numbers(docs: Column) -> Column:
        return F.transform(F.filter(docs, lambda d: d["number"].isNotNull()), lambda d: F.concat(d["type"], F.lit("|"), d["number"]))

    def with_composites(frame: DataFrame, subject: bool, years: Column, docs: Column, countries: Column, places: Column) -> DataFrame:
        named = F.flatten(F.transform("forms", lambda tokens: _name_keys(tokens, F.col("keys"), subject)))
        other = _evidence_keys(sets, F.col("keys"), *(F.coalesce(F.array_distinct(c), empty) for c in (years, numbers(docs), countries, places)))
        return frame.withColumn("composites", F.array_distinct(F.concat(named, other)))

    asked = prepare_subjects(subjects, phonetic).select("subject_id", "s.dob_parts", "s.doc_keys", "s.country", "s.pob_tokens")
    s = with_composites(
        _tokens_of(subject_rows, "subject_id", keyed).join(asked, "subject_id"), True, F.array_compact(F.array(F.col("dob_parts.y").cast("string"))),
        F.col("doc_keys"), F.array_compact(F.array("country")), F.slice(F.array_sort("pob_tokens"), 1, 1))
    # a year range of any width is asked for year by year; circa is two years either way
    none, circa = F.array().cast("array<int>"), lambda d: F.when(d["raw"]["circa"], 2).otherwise(0)
    years = F.flatten(F.transform("dobs", lambda d: F.concat(
        F.array_compact(F.array(d["parts"]["y"])),
        F.when(d["raw"]["from_year"] <= d["raw"]["to_year"], F.sequence(d["raw"]["from_year"], d["raw"]["to_year"])).otherwise(none),
        F.when(d["raw"]["year"].isNotNull(), F.sequence(d["raw"]["year"] - circa(d), d["raw"]["year"] + circa(d))).otherwise(none)))).cast("array<string>")
    listed = prepare_records(records, phonetic).select("record_id", "r.dobs", "r.doc_keys", "r.countries", "r.pob_tokens")
    r = with_composites(
        _tokens_of(record_rows, "record_id", keyed).join(listed, "record_id"), False, years, F.col("doc_keys"), F.array_compact("countries"), F.flatten("pob_tokens"))
    return s.select("subject_id", "keys", "composites"), r.select("record_id", "keys", "composites")


def bounded_candidates(subjects: DataFrame, records: DataFrame, rule: dict, keyed: DataFrame, phonetic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(subject_id, record_id, matched_keys): every pair whose band may be above CLEAR; and (subject_id, n_postings) of subjects with a key on the list.

    ``n_postings`` counts the list entries under all keys of the subject, a record once per key: at least the number of all pairs.
    """
    s, r = composite_keys(subjects, records, rule, keyed, phonetic)
    # Both sides come straight from a shuffle on the composite key, so AQE splits one with long postings.
    left = s.select("subject_id", F.explode("composites").alias("composite"))
    right = r.select("record_id", F.explode("composites").alias("composite"))
    pairs = left.join(right, "composite").select("subject_id", "record_id").distinct()
    hits = F.array_sort(F.array_intersect("keys", "_keys"))
    pairs = pairs.join(s.select("subject_id", "keys"), "subject_id").join(r.select("record_id", F.col("keys").alias("_keys")), "record_id")
    pairs = pairs.select("subject_id", "record_id", hits.alias("matched_keys")).where(F.size("matched_keys") > 0)
    postings = r.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    counts = s.select("subject_id", F.explode("keys").alias("key")).join(postings, "key").groupBy("subject_id").agg(F.sum("n").alias("n_postings"))
    return pairs, counts


def screen_bounded(
    subjects: DataFrame, records: DataFrame, rule: dict, source_status: Column | None = None, phonetic: bool = True, dictionary_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``screen`` over the pairs that can leave CLEAR: (decisions, banded pairs above CLEAR or built on the way).

    Disposition, auto-close flag, reason, MATCH and REVIEW counts and every score of ``clear_below`` and more are those of
    ``screen``. ``n_candidates`` counts built pairs, ``n_postings`` bounds all of them; ``top_score`` is null where no pair was built.
    """
    records = records.repartition("record_id")
    keyed = all_keyed_names(subjects, records, phonetic, dictionary_path)
    pairs, postings = bounded_candidates(subjects, records, rule, keyed, phonetic)
    spoken = subjects.join(dictionary_forms(subjects, "subject_id", spoken_names(subjects), keyed), "subject_id", "left")
    listed = records.join(dictionary_forms(records, "record_id", F.col("names"), keyed), "record_id", "left")
    banded = with_band(score_pairs(pairs, spoken, listed, rule, phonetic), rule["thresholds"])
    unkeyed = subjects.select("subject_id", F.exists(subject_names(subjects), without_keys).alias("unkeyed"))
    decided = rollup(banded, subjects, source_status, unkeyed).join(postings, "subject_id", "left")
    some = (F.col("reason") == "no_candidates") & F.col("n_postings").isNotNull()
    decided = decided.withColumn("reason", F.when(some, "auto_clear_allowed").otherwise(F.col("reason"))).withColumn("n_postings", F.coalesce("n_postings", F.lit(0)))
    return decided, banded
