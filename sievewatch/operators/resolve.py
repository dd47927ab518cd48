"""Entity resolution: rank candidate companies for each submission.

Names and hosts are matched once per distinct (tokens, host), so copies of a company are not compared again. Only pairs
that can reach INCLUDE are built, each of them once:

* equal hosts always reach it;
* other hosts of one registered domain need a common token, so they meet under (domain, rarest common token);
* the rest needs NAME_PART of the smaller name's tokens. Tokens stand in order of rarity. The smaller name keeps a prefix
  that its partner must touch: a single token is looked up as it is, longer names meet under their two rarest common tokens,
  so one token that is in very many names never is a key of these. Names of over LONG tokens are found by their rarest
  common token instead of by all pairs of their tokens.

Rows with neither a name nor a host have no candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewatch.functions.text import entity_tokens

INCLUDE, GAP, STRONG = 0.4, 0.05, 0.85
#: Least common part of the smaller name with 0.6 * part >= INCLUDE after rounding to four digits; a bit below two thirds.
NAME_PART = 0.6665
LONG = 32

def plain_host(c: Column) -> Column:
    """Lower-case host without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^www\.", "")


def root_domain(c: Column) -> Column:
    return F.substring_index(c, ".", -2)


def name_score(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(0.0)


def domain_score(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(root_domain(a) == root_domain(b), 0.8).otherwise(0.0)


def score_candidates(pairs: DataFrame) -> DataFrame:
    """Add name, domain and overall scores to rows with s_tokens, s_host, c_tokens, c_host."""
    ns, ds = name_score(F.col("s_tokens"), F.col("c_tokens")), domain_score(F.col("s_host"), F.col("c_host"))
    return pairs.withColumn("_ns", ns).withColumn("_ds", ds).select(
        *[c for c in pairs.columns if c not in ("s_tokens", "s_host", "c_tokens", "c_host")],
        F.round("_ns", 4).alias("name_score"), F.round("_ds", 4).alias("domain_score"),
        F.round(0.6 * F.col("_ns") + 0.4 * F.col("_ds"), 4).alias("overall_score"))


def _side(df: DataFrame, name: str, host: str, prefix: str) -> DataFrame:
    return df.withColumn(f"{prefix}_tokens", entity_tokens(F.col(name))).withColumn(f"{prefix}_host", plain_host(F.col(host)))


def _by_rarity(tokens: DataFrame) -> DataFrame:
    """Rows of ``tokens`` and ``t``: the same tokens, those in the fewest distinct names first."""
    words = tokens.distinct().select("tokens", F.explode("tokens").alias("word"))
    names = words.groupBy("word").agg(F.count("*").alias("names"))
    placed = words.join(names, "word").groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("names", "word"))).alias("_w"))
    return placed.select("tokens", F.col("_w.word").alias("t"))


def _key(kind: str, a: Column, b: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), a.alias("a"), (F.lit("") if b is None else b).alias("b"))


def _twos(kind: str, tokens: Column) -> Column:
    """Every two of the tokens, the rarer one first."""
    return F.flatten(F.transform(tokens, lambda a, i: F.transform(F.slice(tokens, i + 2, F.size(tokens)), lambda b: _key(kind, a, b))))


def _keys(side: str, other: str) -> Column:
    """Keys of a row: as the smaller name in pairs named ``side``, as the larger one in pairs named ``other``."""
    t, host, n = F.col("t"), F.col("host"), F.size("t")
    need = F.greatest(F.lit(1), F.ceil(n * NAME_PART)).cast("int")
    none = F.filter(F.array(_key("", F.lit(""))), lambda _: F.lit(False))
    return F.concat(
        F.when(host != "", F.concat(F.array(_key("host", host)), F.transform(t, lambda x: _key("domain", root_domain(host), x)))).otherwise(none),
        F.when(n == 1, F.transform(t, lambda x: _key(f"{side}1", x)))
        .when(n > 1, F.concat(_twos(f"{side}2", F.slice(t, 1, n - need + 2)), F.transform(F.slice(t, 1, n - need + 1), lambda x: _key(f"{side}L", x))))
        .otherwise(none),
        F.transform(t, lambda x: _key(f"{other}1", x)),
        F.when(n > LONG, F.transform(t, lambda x: _key(f"{other}L", x))).otherwise(_twos(f"{other}2", t)))


def _meet(s: DataFrame, c: DataFrame) -> DataFrame:
    """Pairs of distinct (tokens, host) of both sides that can reach INCLUDE, each once, with s_tokens, s_host, c_tokens, c_host.

    The tokens of both sides are sorted arrays.
    """
    order = _by_rarity(s.select("tokens").union(c.select("tokens")))

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(order, "tokens", "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
        rows = rows.withColumn("_k", F.explode(_keys(own, other)))
        # one array a row is shuffled: sorted, the tokens by rarity are those of the row
        return rows.select(F.col("host").alias(f"{own}_host"), F.col("t").alias(f"{own}_t"),
                           F.col("_k.kind").alias("kind"), F.col("_k.a").alias("a"), F.col("_k.b").alias("b"))

    both = F.array_intersect("s_t", "c_t")  # keeps the order of rarity
    first, second = F.get(both, F.lit(0)), F.get(both, F.lit(1))
    one_host = (F.col("s_host") != "") & (F.col("s_host") == F.col("c_host"))
    one_root = (F.col("s_host") != "") & (F.col("c_host") != "") & (root_domain(F.col("s_host")) == root_domain(F.col("c_host")))
    s_small = F.size("s_t") <= F.size("c_t")
    kind = F.col("kind")
    by_name = (~one_root & (kind.startswith("s") == s_small) & (F.col("a") == first)
               & ((kind.endswith("1") | kind.endswith("L")) | (F.col("b") == second)))
    kept = F.when(kind == "host", F.lit(True)).when(kind == "domain", ~one_host & (F.col("b") == first)).otherwise(by_name)
    return side(s, "s", "c").join(side(c, "c", "s"), ["kind", "a", "b"]).filter(kept).select(
        F.array_sort("s_t").alias("s_tokens"), "s_host", F.array_sort("c_t").alias("c_tokens"), "c_host")


def resolve_entities(subs: DataFrame, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked candidates, one status row per submission).

    Every submission yields itself as candidate 0. ``hints`` (candidate_id, name, domain, run_id?) add more:
    with run_id they belong to that run, otherwise every hint is a candidate of every submission (found as the module says).
    """
    s = _side(subs.select("run_id", "company_name", "domain"), "company_name", "domain", "s")
    own = s.filter((F.coalesce("company_name", F.lit("")) != "") | (F.coalesce("domain", F.lit("")) != "")).select(
        "run_id", F.lit("").alias("candidate_id"), F.coalesce("company_name", F.lit("")).alias("name"), "domain",
        "s_tokens", "s_host", F.col("s_tokens").alias("c_tokens"), F.col("s_host").alias("c_host"))
    scored = score_candidates(own).filter(F.col("overall_score") >= INCLUDE)
    best = scored.select("run_id", "candidate_id", "name", "overall_score", F.lit(1).cast("long").alias("n"))
    if hints is not None:
        h = _side(hints, "name", "domain", "c")
        if "run_id" in hints.columns:
            left = s.select("run_id", "s_tokens", "s_host")
            more = score_candidates(left.join(h.select("run_id", "candidate_id", "name", "domain", "c_tokens", "c_host"), "run_id"))
        else:
            # equal sets of tokens are equal arrays
            s = s.withColumn("s_tokens", F.array_sort("s_tokens"))
            h = h.withColumn("c_tokens", F.array_sort("c_tokens"))
            pairs = _meet(s.select(F.col("s_tokens").alias("tokens"), F.col("s_host").alias("host")).distinct(),
                          h.select(F.col("c_tokens").alias("tokens"), F.col("c_host").alias("host")).distinct())
            found = score_candidates(pairs.select("*", F.struct("s_tokens", "s_host").alias("_s"), F.struct("c_tokens", "c_host").alias("_c")))
            found = found.filter(F.col("overall_score") >= INCLUDE)
            # the status needs the number and the first two of the candidates that all submissions with one (tokens, host) share
            shared = found.select("_s", "_c", "overall_score").join(h.select("candidate_id", "name", F.struct("c_tokens", "c_host").alias("_c")), "_c").drop("_c")
            first = F.row_number().over(Window.partitionBy("_s").orderBy(F.desc("overall_score"), "candidate_id"))
            count = shared.groupBy("_s").agg(F.count("*").alias("n"))
            two = shared.withColumn("at", first).filter("at <= 2").join(count, "_s").withColumn("n", F.when(F.col("at") == 1, F.col("n")).otherwise(0))
            best = best.unionByName(s.select("run_id", F.struct("s_tokens", "s_host").alias("_s")).join(two, "_s").select(*best.columns))
            more = (found.join(s.select("run_id", F.struct("s_tokens", "s_host").alias("_s")), "_s")
                    .join(h.select("candidate_id", "name", "domain", F.struct("c_tokens", "c_host").alias("_c")), "_c"))
        more = more.select(*scored.columns).filter(F.col("overall_score") >= INCLUDE)
        scored = scored.unionByName(more)
        if "run_id" in hints.columns:
            best = best.unionByName(more.withColumn("n", F.lit(1).cast("long")).select(*best.columns))
    w = Window.partitionBy("run_id").orderBy(F.desc("overall_score"), "candidate_id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    # one row stands for ``n`` candidates, itself and worse ones
    top = best.withColumn("rank", F.row_number().over(w)).groupBy("run_id").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("overall_score"))).alias("top_score"),
        F.max(F.when(F.col("rank") == 2, F.col("overall_score"))).alias("second_score"),
        F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("top_candidate"))
    conflict = (F.col("n") >= 2) & (F.col("top_score") < STRONG) & (
        F.round(F.col("top_score") - F.col("second_score"), 6) <= GAP)
    status = subs.select("run_id").join(top, "run_id", "left").select(
        "run_id", F.when(F.col("n").isNull(), "no_match").when(F.col("n") == 1, "single_match").otherwise("ambiguous").alias("status"),
        F.coalesce("n", F.lit(0)).alias("n_candidates"), F.coalesce(conflict, F.lit(False)).alias("conflict_signal"),
        "top_candidate", "top_score")
    return ranked, status
