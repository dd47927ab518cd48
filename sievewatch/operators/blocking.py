"""Candidate generation: subjects x list records sharing a phonetic key.

Work is done per *distinct name*, never per subject, so a name shared by a
third of all subjects is matched once. A pair is emitted only at the smallest
key both sides share, which removes duplicates without shuffling pairs.
Every pair that shares a key is a candidate, full matches (every keyed token
hit) and partial ones alike: nothing is cut. Both sides of the join come
straight from a shuffle on the key, so AQE splits a key with long postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewatch.functions.names import key_groups, keyed_tokens, name_forms, name_tokens
from sievewatch.operators.name_rank import best_form


def subject_variants(subjects: DataFrame) -> DataFrame:
    """(subject_id, name_key): the normalized form of every name a subject goes by.

    ``subjects`` has ``subject_id`` and ``names array<string>`` (name, original
    script name and aliases).
    """
    return subjects.select("subject_id", F.explode_outer("names").alias("_name")).select(
        "subject_id", F.array_join(name_tokens(F.col("_name")), " ").alias("name_key")
    )


def distinct_names(variants: DataFrame, phonetic: bool = True) -> DataFrame:
    """One row per distinct normalized name with its key groups."""
    names = variants.select("name_key").distinct()
    groups = key_groups(F.split("name_key", " "), phonetic)
    return names.select("name_key", groups.alias("groups")).withColumn("keys", F.array_distinct(F.flatten("groups")))


def record_keys(records: DataFrame, phonetic: bool = True) -> DataFrame:
    """(record_id, keys): the union of the keys of all name variants of a record.

    ``records`` has ``record_id`` and ``names array<string>``.
    """
    keys = F.array_distinct(
        F.flatten(F.flatten(F.transform("names", lambda n: key_groups(name_tokens(n), phonetic))))
    )
    return records.select("record_id", keys.alias("keys"))


def _is_full(groups, keys):
    return F.forall(groups, lambda g: F.arrays_overlap(g, keys))


def candidate_names(names: DataFrame, recs: DataFrame) -> DataFrame:
    """(name_key, record_id, hits, is_full): each pair sharing a key, emitted once at its smallest shared key."""
    # explode_outer: a plain explode would infer a size filter and compute the keys twice.
    left = names.select("name_key", "groups", "keys", F.explode_outer("keys").alias("key"))
    right = recs.select("record_id", F.col("keys").alias("rec_keys"), F.explode_outer("keys").alias("key"))
    joined = left.join(right, "key").withColumn("hits", F.array_intersect("keys", "rec_keys"))
    return joined.filter(F.col("key") == F.array_min("hits")).select(
        "name_key", "record_id", "hits", _is_full(F.col("groups"), F.col("rec_keys")).alias("is_full")
    )


def with_name_ranks(pairs: DataFrame, names: DataFrame, records: DataFrame, phonetic: bool = True) -> DataFrame:
    """Add ``name_rank`` (best rank and record name position) once per distinct name and record.

    A name shared by many subjects is compared once, before its pairs fan out to them.
    """
    tokens = names.select("name_key", keyed_tokens(F.split("name_key", " "), phonetic).alias("_tokens"))
    forms = records.select("record_id", name_forms(F.col("names"), phonetic).alias("_forms"))
    # the forms of a record are the widest part, so they are never shuffled with the pairs
    joined = pairs.join(tokens, "name_key").join(forms, "record_id")
    return joined.withColumn("name_rank", best_form(F.col("_tokens"), F.col("_forms"))).drop("_tokens", "_forms")


def block(
    subjects: DataFrame, records: DataFrame, phonetic: bool = True, compare: bool = False,
) -> DataFrame:
    """(subject_id, record_id, matched_keys, is_full): union of candidates over all subject names.

    With ``compare`` also ``name_ranks``, a map from each blocked name to its name rank.
    The result is then partitioned by ``record_id``, so scoring joins the records without another shuffle.
    """
    variants = subject_variants(subjects)
    names = distinct_names(variants, phonetic)
    pairs = candidate_names(names, record_keys(records, phonetic))
    extra = []
    if compare:
        pairs = with_name_ranks(pairs, names, records, phonetic)
        extra = [F.map_from_entries(F.collect_set(F.struct("name_key", "name_rank"))).alias("name_ranks")]
    fanned = variants.select("subject_id", "name_key").distinct().join(pairs, "name_key")
    if compare:  # where the records are joined next
        fanned = fanned.repartition("record_id")
    return (
        fanned.groupBy("subject_id", "record_id")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("matched_keys"),
            F.max("is_full").alias("is_full"), *extra,
        )
    )
