import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np

from sievewatch.llm import divergence, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) term by term."""
    rows = [(t or "", lang or "", s or "") for _, t, lang, s, _ in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for lang in {r[1] for r in rows}:
        held = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), s) for t, g, s in rows if g == lang]
        seen = Counter(w for words, _ in held for w in set(words))
        kept = sorted(w for w, n in seen.items() if n >= least)
        by = {s: Counter() for _, s in held}
        for words, s in held:
            by[s].update(w for w in words if seen[w] >= least)
        whole = sum(by.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (c.total() + 2 * len(kept))
        price = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in by.items():
            pairs = [(sum(price(share(c, w), share(by[o], w)) for w in kept), o) for o in by if o != s]
            terms = [(price(share(c, w), share(whole, w)), w) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, items, last in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:last]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def corpus():
    rng = random.Random(2)
    words = ["the", "Of", "ÄPFEL", "naïve", "x1y", "don't", "日本", *(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for n in range(500):
        source = "hot" if n % 3 == 0 else rng.choice(["a", "b", "c", "Z", "é", None, ""])
        rows.append((n, " ".join(rng.choices(words, weights, k=rng.choice([0, 2, 30, 200]))), rng.choice(["en", "en", "de"]), source, 0))
    rows += rows[:20]
    rows += [(900, None, "en", "silent", 0), (901, "", None, None, 0), (902, "1 2 3", "", "digits", 0), (903, "the " * 100_000, "en", "long", 0), (904, "only one", "xx", "alone", 0), (None, "the of", "de", "a", 0)]
    return rows


def test_matches_the_definition(spark):
    docs = spark.createDataFrame(corpus(), DOC).repartition(5).selectExpr("*", "1 AS term", "'x' AS n", "2 AS counts", "3 AS value")
    got = sorted(map(tuple, divergence.source_divergence(docs).collect()))
    assert got == plain(corpus())


def test_joint_tables(spark):
    rows = corpus()
    levels = divergence.count_levels(spark.createDataFrame(rows, DOC))
    got = {tuple(r)[:-1]: r.terms for r in divergence.joint_tables(levels).collect()}
    expected = Counter()
    for lang, sources, counts in ((r.lang, r.sources, r.counts) for r in levels.terms.collect()):
        for (i, a), (j, b) in itertools.combinations(enumerate(counts), 2):
            expected[lang, sources[i], a, sources[j], b] += 1
    assert got == dict(expected) and any(k[2] == 0 for k in got)


def test_cells_over_many_tiles(monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 7)
    counts = np.random.default_rng(1).integers(0, 9, (40, 6))
    source, row, _ = divergence._columns(counts)
    got = {(int(source[i]), int(counts[row[i], source[i]]), int(source[j]), int(counts[row[j], source[j]])): int(n) for a, b, c in divergence.joint_cells(counts) for i, j, n in zip(a, b, c, strict=True)}
    expected = Counter((i, int(r[i]), j, int(r[j])) for r in counts for i, j in itertools.combinations(range(6), 2))
    assert got == dict(expected)


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**13, 3 * 10**13, 7), (0, 5, 1), (2**40, 2**41, 2**30)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("*", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v) for r in got]


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOC)).count() == 0


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = con.execute(divergence.DIVERGENCE_SQL).fetchall()
    got = queries.op13_source_divergence(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and expected
