"""URL rules, extended to unlisted urls by trust and distrust that spread over links between hosts.

Rules decide first: the longest one whose host is the url's host or a domain above it and whose path the url's path
begins with. Pages that a rule allows make their host a trusted seed, pages that one blocks make it a blocked seed, each
weighted by its number of pages. Trust is the personalised PageRank of the trusted seeds along links; distrust is that of
the blocked seeds along reversed links (who links to blocked hosts is suspect). Links are those of the pages' html to
other hosts, plus one each way between a host and the domain above it. A host is blocked if its distrust is above zero
and reaches ``ratio`` times its trust; all others are allowed.

DataFrame functions only. Links are counted per pair of hosts before any shuffle of scores, scores of a round meet the
links in one join and one partial aggregate, and joined tables are written first, so that AQE may split a host that
has a third of all links or pages. ``rules`` is a short policy list (MAX_RULES) and becomes part of the expression.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; null html has no
links; repeated pages count again and are judged alike; null page ids pass; an empty table gives no rows; further columns
are not looked at. Mass at a host without links leaves the graph.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewatch.llm.common import stage

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_RULES = 2000
ROUNDS = 12
DAMPING = 0.85
RATIO = 1.0
#: Rounds between two written tables.
WRITTEN = 4
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def lower_ascii(column: Column) -> Column:
    return F.translate(column, ascii_uppercase, ascii_lowercase)


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path`` in place of any columns of these names."""
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(F.col("_rest"), "^[^/?#]*", 0)
    return pages.withColumn("_rest", rest).withColumns({"host": lower_ascii(host), "path": F.regexp_extract(F.expr("substr(_rest, length(regexp_extract(_rest, '^[^/?#]*', 0)) + 1)"), "^[^?#]*", 0)}).drop("_rest")


def ranked(rules: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    """Longest first; of two equal strings the blocking one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    return sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0] != "block"))


def rule_of(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The rule that fits ``host`` and ``path``, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in reversed(ranked(rules)):
        domain, path = text.split("/", 1)
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, and one each way between a host and the domain above it."""
    linked = with_host_and_path(pages.select(url_col, html_col), url_col).where("host <> ''")
    found = linked.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    found = stage(found, "links")
    hosts = linked.select("host").unionAll(found.select("dst")).distinct()
    above = hosts.where(F.col("host").rlike(r"^[^.]+\.[^.]+\..+$")).select("host", F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("above"))
    above = stage(above, "domains")
    site = above.select(F.col("host").alias("src"), F.col("above").alias("dst")).unionAll(above.select("above", "host"))
    return found.unionAll(site.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``links`` (kind, src, dst, n) and ``seeds`` (kind, host, n) -> (kind, host, score): a PageRank for each kind."""
    links, seeds = stage(links, "graph"), stage(seeds, "seeds")
    out = stage(links.groupBy("kind", "src").agg(F.sum("n").alias("total")), "out-degrees")
    links = links.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.lit(damping) * F.col("n") / F.col("total")).alias("share"))
    links = stage(links, "shares")
    totals = seeds.groupBy("kind").agg(F.sum("n").alias("total"))  # one row per kind
    seeds = seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("score"))
    score = seeds = stage(seeds, "seed-scores")
    for k in range(1, rounds + 1):
        moved = links.join(score.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("score")).alias("score"))
        back = seeds.select("kind", "host", (F.lit(1 - damping) * F.col("score")).alias("score"))
        score = moved.unionAll(back).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % WRITTEN == 0 or k == rounds:
            score = stage(score, "scores")
    return score


def judge_pages(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, ratio: float = RATIO,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(id_col, host, path, rule, verdict, trust, distrust) of each page; scores are those of the host, 0 if it has none."""
    rule, verdict = rule_of(rules)
    judged = with_host_and_path(pages.select(id_col, url_col), url_col).select(id_col, "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    seeds = judged.where("ruled IS NOT NULL").groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    links = stage(host_links(pages, url_col, html_col), "host-links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionAll(links.select(F.lit("distrust").alias("kind"), "dst", "src", "n"))
    scores = spread(both, seeds, rounds, damping)
    hosts = scores.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    hosts = stage(hosts.withColumnRenamed("host", "scored_host"), "host-scores")
    joined = judged.join(hosts, F.col("host") == F.col("scored_host"), "left")
    by_method = F.when((F.col("distrust") > 0) & (F.col("distrust") >= ratio * F.col("trust")), "block").otherwise("allow")
    return joined.select(
        id_col, "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def judge_sql(rules: tuple[tuple[str, str], ...] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, ratio: float = RATIO) -> str:
    """The same in DuckDB's SQL, round by round."""
    whens = [f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}') THEN " for d, p in (t.split("/", 1) for _, t in ranked(rules))]
    chosen = " ".join(w + f"'{t}'" for w, (_, t) in zip(whens, ranked(rules), strict=True))
    ruled = " ".join(w + f"'{k}'" for w, (k, _) in zip(whens, ranked(rules), strict=True))
    low = f"translate({{}}, '{ascii_uppercase}', '{ascii_lowercase}')"
    link = LINK.replace("'", "''")
    steps = ",\n".join(
        f"""s{k} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
  SELECT l.kind, l.dst AS host, l.share * s.score AS score FROM shares l JOIN s{k - 1} s ON l.kind = s.kind AND l.src = s.host
  UNION ALL SELECT kind, host, {1 - damping!r} * score FROM s0) GROUP BY kind, host)"""
        for k in range(1, rounds + 1)
    )
    return f"""
WITH rest AS MATERIALIZED (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS MATERIALIZED (SELECT page_id, html, {low.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
judged AS MATERIALIZED (SELECT page_id, host, path, CASE {chosen} END AS rule, CASE {ruled} END AS ruled FROM named),
found AS MATERIALIZED (SELECT src, {low.format("dst")} AS dst FROM
  (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM named WHERE host <> '') WHERE src <> {low.format("dst")}),
hosts AS (SELECT host FROM named WHERE host <> '' UNION SELECT dst FROM found),
above AS (SELECT host, regexp_extract(host, '^[^.]+\\.(.+)$', 1) AS above FROM hosts WHERE regexp_matches(host, '^[^.]+\\.[^.]+\\..+$')),
links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM
  (SELECT src, dst FROM found UNION ALL SELECT host, above FROM above UNION ALL SELECT above, host FROM above) GROUP BY src, dst),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
shares AS MATERIALIZED (SELECT kind, src, dst, {damping!r} * n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
seeds AS (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged WHERE ruled IS NOT NULL GROUP BY 1, 2),
s0 AS MATERIALIZED (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS score FROM seeds),
{steps},
scored AS (SELECT host, sum(CASE kind WHEN 'trust' THEN score ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN score ELSE 0 END) AS distrust FROM s{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN distrust > 0 AND distrust >= {ratio!r} * trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scored s ON j.host = s.host
"""
