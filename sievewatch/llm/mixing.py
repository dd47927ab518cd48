"""Mixing sources to target weights by Poisson replication.

A source with target share w of a budget of B bytes and n bytes of its own repeats each document B * w / n times on
average. The number of copies of a document is the inverse of the Poisson distribution with that mean at a number in
(0, 1) hashed from seed, id and text, so a lost task draws the same copies again and sources need no coordination. The
copies are exploded and dealt out by a hash of document and copy, in the order of that hash within a partition: a global
shuffle with a single exchange.

Means above PART are drawn as the sum of equal independent parts, so that no term of a distribution underflows.

Defined cases: a null source is a source of its own; null and empty texts count one byte; repeated rows (equal id and
text) get equal counts; a source without a given weight gets none; an empty table gives no rows. Other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewatch.llm.common import stage, text_of

SEED = 17
PART = 32.0
#: Terms of a distribution of mean PART at most; the rest has a probability below 1e-16.
TERMS = 120


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) with 52 random bits from the MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(mix_source, rate, parts, cdf): mean copies of each source and the distribution of one part.

    Without ``weights`` the target share of a source is proportional to the square root of its bytes.
    """
    size = F.octet_length(text_of(text_col)) + 1
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("mix_source")).agg(F.sum(size).alias("bytes"))
    if weights is None:
        target = F.sqrt(F.col("bytes").cast("double"))
    else:
        given = [(None if s is None else str(s), float(w)) for s, w in weights.items()]
        named = docs.sparkSession.createDataFrame(given, "given_source string, given double")
        sizes = sizes.join(named, F.col("mix_source").eqNullSafe(F.col("given_source")), "left")
        target = F.coalesce("given", F.lit(0.0))
    # one row per source; totals are taken once and joined, not windowed
    sizes = sizes.withColumn("target", target)
    totals = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum("target").alias("all_targets"))
    rate = F.col("all_bytes") * F.col("target") / F.col("all_targets") * F.lit(float(epochs)) / F.col("bytes")
    rated = sizes.crossJoin(F.broadcast(totals)).withColumn("rate", F.coalesce(rate, F.lit(0.0)))  # totals: one row
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))).withColumn("mean", F.col("rate") / F.col("parts"))
    cdf = F.expr(
        f"""aggregate(sequence(1, {TERMS}), struct(exp(-mean) AS p, array(exp(-mean)) AS c),
            (s, k) -> struct(s.p * mean / k AS p, array_append(s.c, element_at(s.c, -1) + s.p * mean / k) AS c), s -> s.c)"""
    )
    return rated.select("mix_source", "rate", "parts", cdf.alias("cdf"))


def poisson_copies(docs: DataFrame, rates: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row: the columns of ``docs``, mix_key, mix_copies: how often the row goes into the mix)."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col).cast("binary")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("mix_key"), F.col(source_col).cast("string").alias("own_source"))
    joined = rows.join(stage(rates, "rates"), F.col("own_source").eqNullSafe(F.col("mix_source")))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")), F.lit(0),
        lambda total, part: total + F.size(F.filter("cdf", lambda c: c < uniform(F.col("mix_key"), part.cast("string")))),
    )
    return joined.select("row", "mix_key", F.when(F.col("rate") > 0, draw).otherwise(0).alias("mix_copies"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` replicated and shuffled, with ``mix_copies``, ``mix_copy`` (from 1) and ``mix_order`` (hexadecimal) in place
    of any columns of these names."""
    counted = poisson_copies(docs, source_rates(docs, weights, epochs, text_col, source_col), seed, id_col, text_col, source_col)
    copies = counted.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    order = F.md5(F.concat_ws(":", "mix_key", F.lit("copy"), F.col("mix_copy").cast("string")).cast("binary"))
    dealt = copies.withColumn("mix_order", order).repartition("mix_order").sortWithinPartitions("mix_order")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("mix_copies", "mix_copy", "mix_order")]
    return dealt.select(*own, "mix_copies", "mix_copy", "mix_order")


MIX_SQL = f"""
WITH sizes AS (SELECT source, sum(strlen(coalesce(text, '')) + 1) AS bytes FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(bytes) FROM sizes) * sqrt(bytes::DOUBLE) / (SELECT sum(sqrt(bytes::DOUBLE)) FROM sizes) / bytes AS rate FROM sizes),
terms AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, {TERMS + 1}) AS r(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
keyed AS (SELECT doc_id, source, concat('{SEED}:', coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, ''))) AS mix_key FROM documents),
drawn AS (SELECT *, ((('0x' || substr(md5(mix_key || ':1'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM keyed),
counted AS (
  SELECT doc_id, d.source, mix_key, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c < d.u)::INT AS mix_copies
  FROM drawn d)
SELECT doc_id, source, mix_copies, n::INT AS mix_copy, md5(mix_key || ':copy:' || n::VARCHAR) AS mix_order
FROM counted, LATERAL (SELECT unnest(range(1, mix_copies + 1)) AS n)
"""
