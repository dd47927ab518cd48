"""Entity resolution against all pairs."""

import random

from sievewatch.operators import resolve
from sievewatch.functions.text import ENTITY_STOP_WORDS


def tokens(name):
    words = set((name or "").lower().split())
    return words - set(ENTITY_STOP_WORDS) or words


def host(domain):
    return (domain or "").strip().lower().removeprefix("www.")


def plain_score(a, b):
    x, y = tokens(a[0]), tokens(b[0])
    ns = len(x & y) / min(len(x), len(y)) if x and y else 0.0
    g, h = host(a[1]), host(b[1])
    ds = 0.0 if not g or not h else 1.0 if g == h else 0.8 if g.split(".")[-2:] == h.split(".")[-2:] else 0.0
    return round(0.6 * ns + 0.4 * ds, 4)


def plain(subs, hints):
    out = set()
    for run, *s in subs:
        found = ([("", s)] if s[0] or s[1] else []) + [(c, h) for c, *h in hints]
        scores = sorted((-plain_score(s, h), c) for c, h in found if plain_score(s, h) >= 0.4)
        out |= {(run, c, -score, rank) for rank, (score, c) in enumerate(scores, 1)}
    return out


def ranked(spark, subs, hints):
    s = spark.createDataFrame(subs, "run_id long, company_name string, domain string")
    h = spark.createDataFrame(hints, "candidate_id string, name string, domain string")
    got, status = resolve.resolve_entities(s, h)
    rows = [(r.run_id, r.candidate_id, r.overall_score, r["rank"]) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows), {r.run_id: r for r in status.collect()}


def test_equal_to_all_pairs(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["trade"] * 25 + ["the", "of"]
    hosts = [None, "", "a.org", "www.a.org", "shop.a.org", "b.net", "x.b.net", "localhost", "WWW.B.net", "c.co.uk", "d.co.uk"]

    def row(key):
        size = draw.choice([0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 12, 45])
        return (key, " ".join(draw.choices(words, k=size)) or draw.choice([None, ""]), draw.choice(hosts))

    subs, hints = [row(i) for i in range(150)], [row(f"c{i}") for i in range(200)]
    long = " ".join(f"w{i}" for i in range(40))
    hints += [("long", long, None), ("longer", long + " " + " ".join(f"v{i}" for i in range(30)), None)]
    subs += [(900, long, None), (901, " ".join(f"w{i}" for i in range(28)), None), (902, "w3", None)]
    got, status = ranked(spark, subs, hints)
    want = plain(subs, hints)
    assert {(r, c): s for r, c, s, _ in got} == {(r, c): s for r, c, s, _ in want}
    assert got == want
    assert (900, "longer") in {(r, c) for r, c, *_ in got} and (902, "long") in {(r, c) for r, c, *_ in got}
    for run, *_ in subs:
        mine = [x for x in want if x[0] == run]
        assert status[run]["n_candidates"] == len(mine)
        assert status[run]["status"] == ("no_match" if not mine else "single_match" if len(mine) == 1 else "ambiguous")


def test_pairs_do_not_grow_with_a_common_word(spark):
    def side(n):
        return spark.createDataFrame([([f"a{i}", f"b{i}", "trading", "house"], "") for i in range(n)], "tokens array<string>, host string")

    # all names share two of four tokens, which is below two thirds: only each name with itself is left
    assert resolve._meet(side(300), side(300)).count() == 300
    joined = side(300).join(resolve._by_rarity(side(300).select("tokens")), "tokens")
    keys = joined.selectExpr("t").first().t
    assert keys[:2] != ["house", "trading"] and set(keys[2:]) == {"house", "trading"}


def test_copies_and_empty_tables(spark):
    subs = [(1, "Blue Door Ltd", "blue.org"), (2, "Blue Door Ltd", "blue.org"), (3, None, None)]
    hints = [("x", "Blue Door", None), ("x", "Blue Door", None), ("y", "Door", "www.blue.org"), (None, None, None)]
    s = spark.createDataFrame(subs, "run_id long, company_name string, domain string")
    h = spark.createDataFrame(hints, "candidate_id string, name string, domain string")
    got, status = resolve.resolve_entities(s, h)
    rows = sorted((r.run_id, r["rank"], r.candidate_id, r.overall_score) for r in got.collect())
    assert rows == [(k, *x) for k in (1, 2) for x in ((1, "", 1.0), (2, "y", 1.0), (3, "x", 0.6), (4, "x", 0.6))]
    assert {r.run_id: r.status for r in status.collect()} == {1: "ambiguous", 2: "ambiguous", 3: "no_match"}
    got, status = resolve.resolve_entities(s, h.limit(0))
    assert got.count() == 2 and status.count() == 3
    assert resolve.resolve_entities(s.limit(0), h)[1].count() == 0


def test_hints_of_a_run(spark):
    s = spark.createDataFrame([(1, "Blue Door", ""), (2, "Red Gate", "")], "run_id long, company_name string, domain string")
    h = spark.createDataFrame([(1, "a", "Red Gate", ""), (2, "b", "Red Gate House", "")], "run_id long, candidate_id string, name string, domain string")
    got, _ = resolve.resolve_entities(s, h)
    assert {(r.run_id, r.candidate_id) for r in got.collect()} == {(1, ""), (2, ""), (2, "b")}
