"""Officers and owners: merge declared with registry people, link them to known subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewatch.functions.dates import dob_compatible
from sievewatch.functions.names import name_tokens
from sievewatch.sources.evidence import emit, item

SOURCE = "struct<source:string,provider:string,locator:string>"
PERSON = (
    "struct<name:string,relationships:array<string>,roles:array<string>,"
    f"sources:array<{SOURCE}>,dob:string,nationality:string,ownership_pct:double>"
)
_KEPT = ("dob", "nationality", "ownership_pct")


def person_key(c: Column) -> Column:
    """Screening tokens of the name joined by a space."""
    return F.array_join(name_tokens(c), " ")


def declared_people(submissions: DataFrame) -> DataFrame:
    """Explode the people a submission declares, in the order given."""
    return submissions.select("run_id", F.posexplode("people").alias("pos", "p")).select(
        "run_id", F.lit(0).alias("origin"), "pos", "p.*", F.lit("declared").alias("source"),
        F.lit(None).cast("string").alias("provider"), F.lit("submission").alias("locator"))


def registry_people(subs: DataFrame, registry: DataFrame, provider: str = "registry") -> DataFrame:
    """Landed registry people (company_name, pos, name, relationship, role, dob, ...) per run, by normalized company name."""
    want = subs.select("run_id", person_key(F.col("company_name")).alias("_k"))
    have = registry.select(person_key(F.col("company_name")).alias("_k"), "pos", "name", "relationship", "role", "dob", "nationality", "ownership_pct", "locator")
    return want.join(have, "_k").select(
        "run_id", F.lit(1).alias("origin"), "pos", "name", "relationship", "role", "dob", "nationality", "ownership_pct",
        F.lit("registry").alias("source"), F.lit(provider).alias("provider"), "locator")


def merge_people(declared: DataFrame, registry: DataFrame) -> DataFrame:
    """Fold people of a run that share a name key and have compatible birth dates.

    The rule is sequential: a person joins the first earlier one it is compatible with, first-seen
    values win, relationships, roles and sources accumulate. A fold runs per (run, name key); a group
    holds the few mentions of one name at one company (intake allows 50 people).
    """
    both = declared.unionByName(registry)
    ok = lambda c: F.filter(F.array(c), lambda x: F.coalesce(x, F.lit("")) != "")
    one = F.struct(
        F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name"), F.array("relationship").alias("relationships"),
        ok(F.col("role")).alias("roles"), F.array(F.struct("source", "provider", "locator")).alias("sources"), *_KEPT).cast(PERSON)
    groups = both.select("run_id", person_key(F.col("name")).alias("person_key"), F.struct("origin", "pos", one.alias("p")).alias("m")).groupBy(
        "run_id", "person_key").agg(F.array_sort(F.collect_list("m")).alias("mentions"))

    def join_in(old: Column, new: Column) -> Column:
        return F.struct(
            old["name"].alias("name"),
            F.when(F.size(F.array_except(new["relationships"], old["relationships"])) == 0, old["relationships"])
            .otherwise(F.array_sort(F.array_union(old["relationships"], new["relationships"]))).alias("relationships"),
            F.concat(old["roles"], F.array_except(new["roles"], old["roles"])).alias("roles"),
            F.concat(old["sources"], new["sources"]).alias("sources"),
            *[F.coalesce(old[c], new[c]).alias(c) for c in _KEPT]).cast(PERSON)

    def step(acc: Column, m: Column) -> Column:
        new = m["p"]
        at = F.array_position(F.transform(acc, lambda old: dob_compatible(old["dob"], new["dob"])), True)
        return F.when(at > 0, F.transform(acc, lambda old, i: F.when(i == at - 1, join_in(old, new)).otherwise(old))).otherwise(
            F.concat(acc, F.array(new)))

    merged = F.aggregate("mentions", F.array().cast(f"array<{PERSON}>"), step)
    first = F.element_at("mentions", 1)
    return groups.select("run_id", "person_key", first["origin"].alias("origin"), first["pos"].alias("pos"), F.posexplode(merged).alias("nth", "p")).select(
        "run_id", F.sha2(F.concat_ws("|", F.col("run_id").cast("string"), "person_key", F.col("nth").cast("string")), 256).alias("person_id"),
        "person_key", "nth", "p.*")


def link_people(people: DataFrame, known: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people with their subject, subjects to create).

    ``known``: entity_id, subject_id, name, dob, created_at. The oldest compatible subject of the same
    entity is reused; what was known first wins.
    """
    have = known.select("entity_id", F.col("subject_id").alias("_sid"), person_key(F.col("name")).alias("person_key"),
                        F.col("dob").alias("_dob"), F.col("created_at").alias("_at"))
    # of known subjects with one entity, name and birth date only the oldest is ever taken
    have = have.filter("_sid IS NOT NULL").groupBy("entity_id", "person_key", "_dob").agg(F.min(F.struct("_at", "_sid")).alias("_k")).select(
        "entity_id", "person_key", "_dob", "_k._at", "_k._sid")
    rows = people.join(runs.select("run_id", "entity_id"), "run_id")
    cand = rows.join(have, ["entity_id", "person_key"], "left").withColumn("_ok", F.col("_sid").isNotNull() & dob_compatible(F.col("_dob"), F.col("dob")))
    keep = [c for c in rows.columns if c not in ("entity_id", "run_id", "person_id")]
    best = cand.groupBy("run_id", "person_id", "entity_id").agg(
        F.first(F.struct(*keep)).alias("p"),
        F.min_by(F.struct("_sid", "_dob"), F.when(F.col("_ok"), F.struct("_at", "_sid"))).alias("k"))
    new_id = F.sha2(F.concat_ws("|", F.lit("subject"), F.col("entity_id").cast("string"), F.col("p.person_key"), F.coalesce("p.dob", F.lit(""))), 256)
    linked = best.select("run_id", "person_id", "entity_id", "p.*", F.coalesce(F.col("k._sid").cast("string"), new_id).alias("subject_id"),
                         F.col("k._sid").isNull().alias("is_new"), F.coalesce("k._dob", "p.dob").alias("subject_dob"))
    return linked, linked.filter("is_new").select("subject_id", "entity_id", "name", "dob", "nationality").dropDuplicates(["subject_id"])


def company_links(linked: DataFrame, existing: DataFrame) -> DataFrame:
    """Upsert links by (entity, subject, relationship): role and sources refresh, ownership only for owners."""
    new = linked.select("entity_id", "subject_id", "run_id", F.explode("relationships").alias("relationship"),
                        F.try_element_at("roles", F.lit(1)).alias("_role"), F.to_json("sources").alias("_sources"),
                        F.col("ownership_pct").alias("_pct"))
    key = ["entity_id", "subject_id", "relationship"]
    new = new.groupBy(*key).agg(F.max_by(F.struct("run_id", "_role", "_sources", "_pct"), "run_id").alias("n"))
    merged = existing.select(*key, F.struct("first_run_id", "role", "sources", "ownership_pct").alias("o")).join(new, key, "full_outer")
    return merged.select(
        *key, F.coalesce("o.first_run_id", "n.run_id").alias("first_run_id"), F.coalesce("n._role", "o.role").alias("role"),
        F.coalesce("n._sources", "o.sources").alias("sources"),
        F.when(F.col("relationship") == "owner", F.coalesce("n._pct", "o.ownership_pct")).otherwise(F.col("o.ownership_pct")).alias("ownership_pct"))


def officer_evidence(linked: DataFrame, decisions: DataFrame, as_of) -> DataFrame:
    """One evidence row per screened person with the disposition, or ``unavailable`` without a decision."""
    d = decisions.select(F.col("subject_id").cast("string").alias("subject_id"), "disposition", "auto_closed", "top_score")
    rows = linked.join(d, "subject_id", "left")
    payload = F.to_json(F.struct("person_id", F.col("subject_id").alias("screening_subject_id"), "relationships", "roles", "sources",
                                 "ownership_pct", "auto_closed", "top_score"))
    return emit(rows, "officer_screening", 1, [item("officer_screening_result", F.coalesce("disposition", F.lit("unavailable")), confidence=0.9, payload=payload)], as_of)


def officer_panel(evidence: DataFrame, subjects: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Screened people of each run with the current subject state and latest human disposition."""
    body = "struct<screening_subject_id:string,relationships:array<string>,roles:array<string>,ownership_pct:double,top_score:double>"
    rows = evidence.filter(F.col("field") == "officer_screening_result").select(
        "run_id", F.col("normalized_value").alias("system_disposition"), F.from_json("raw_payload", body).alias("p"))
    subs = subjects.select(F.col("subject_id").cast("string").alias("subject_id"), F.col("shredded_at").isNotNull().alias("shredded"))
    w = Window.partitionBy("subject_id").orderBy(F.desc("created_at"), "disposition_id")
    human = dispositions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(
        F.col("subject_id").cast("string").alias("subject_id"), F.col("disposition").alias("human_disposition"))
    return (rows.select("run_id", "system_disposition", F.col("p.screening_subject_id").alias("subject_id"), "p.relationships", "p.roles",
                        "p.ownership_pct", "p.top_score")
            .join(subs, "subject_id", "left").join(human, "subject_id", "left"))
