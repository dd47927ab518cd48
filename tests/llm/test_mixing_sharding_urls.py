import math
from collections import Counter

import duckdb
import pytest

from sievewatch.llm import mixing, sharding, url_graph


def test_copies_follow_the_target_weights(make_docs):
    rows = [(i, "x" * 99, "a" if i % 3 else "b") for i in range(6000)]
    got = mixing.mix_sources(make_docs(rows, "rate parts row mix_key"), {"a": 1.0, "b": 3.0}).collect()
    seen = Counter(r.source for r in got)
    assert abs(seen["b"] / len(got) - 0.75) < 0.02 and abs(len(got) / 6000 - 1) < 0.05
    copies = Counter((r.doc_id) for r in got if r.source == "b")
    counts = Counter(copies.values())
    mean = 6000 * 0.75 / 2000
    for k in range(1, 5):
        assert abs(counts[k] / 2000 - math.exp(-mean) * mean**k / math.factorial(k)) < 0.04
    assert len({r.mix_order for r in got}) == len(got)


def test_mixing_odd_rows_and_large_means(make_docs):
    rows = [(1, None, None), (1, None, None), (2, "", None), (None, "x", "b"), (3, "y" * 50_000, "a")]
    got = mixing.mix_sources(make_docs(rows, "rate"), {None: 1.0, "b": 1000.0}, epochs=1.0).collect()
    assert {r.source for r in got} <= {None, "b"}
    b = [r for r in got if r.source == "b"]
    assert abs(len(b) - 25_000) < 1000 and [r.mix_copy for r in sorted(b, key=lambda r: r.mix_copy)] == list(range(1, len(b) + 1))
    assert len({r.mix_copies for r in got if r.doc_id == 1}) <= 1
    assert mixing.mix_sources(make_docs([])).count() == 0


def test_same_draws_again(make_docs):
    docs = make_docs([(i, f"t{i}", f"s{i % 4}") for i in range(500)])
    a, b = (sorted(map(tuple, mixing.mix_sources(d).collect())) for d in (docs, docs.repartition(7)))
    assert a == b


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_near_equal_and_slots_gapless(make_docs, hot, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 16)
    rows = [(i, "é" * (i * 7919 % 900), f"s{i % 5}") for i in range(2500)] + [(5000 + i, "copy " * 3, "a") for i in range(60)]
    if hot:
        rows += [(9000 + i, "hot text " * 40, "a") for i in range(1500)]
    rows += [(None, None, None), (None, None, None), (3, rows[3][1])]
    got = sharding.kd_shards(make_docs(rows, "id size shard bucket"), 40).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 40
    assert set(sizes) == set(range(40)) and max(abs(s - mean) for s in sizes.values()) < 0.08 * mean
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.id is not None and 5000 <= r.id < 5060}) == 1  # a small group of copies stays together


def test_sharding_small_tables(make_docs):
    assert sharding.kd_shards(make_docs([])).count() == 0
    got = sharding.kd_shards(make_docs([(1, "a"), (2, "a"), (3, None)])).collect()
    assert len(got) == 3 and {r.size for r in got} == {17, 16}
    assert max(r.shard for r in sharding.kd_shards(make_docs([(i, "x" * 84) for i in range(100)]), target_bytes=1000).collect()) == 9


PAGES = "page_id long, url string, html string, host string, path string, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)


def test_rules_and_spread(spark):
    page = '<a href="{}">x</a>'
    rows = [
        (1, "http://A.com/x", None), (2, "https://Example.COM/en/1?q#f", ""), (3, "http://www.example.com/en/2", None), (4, "http://b.net/es/1", page.format("http://clean.org/")),
        (5, "http://b.net/de/1", None), (6, "http://link.org/", page.format("//B.net/x") * 3), (7, "http://far.org/p", page.format("https://link.org")), (8, "http://clean.org", None),
        (9, None, page.format("http://b.net/")), (10, "no scheme", None), (11, "http://a.com", None), (12, "http://xexample.com/en/", None), (13, "http://net/fr/", None), (None, "http://b.net/fr", None),
        (1, "http://A.com/x", None), (14, "http://good.org/", page.format("/own")), (15, "http://a.com/y", page.format("http://good.org/z")),
    ]
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_graph.judge_pages(pages(spark, rows)).collect()}
    assert got[1, "a.com", "/x"] == ("com/", "allow")
    assert got[2, "example.com", "/en/1"] == ("example.com/en/", "block")
    assert got[3, "www.example.com", "/en/2"] == ("www.example.com/en/", "allow")
    assert got[4, "b.net", "/es/1"] == ("net/es/", "block")
    assert got[5, "b.net", "/de/1"] == (None, "block")  # a blocked seed
    assert got[6, "link.org", "/"] == got[7, "far.org", "/p"] == (None, "block")  # they link to it
    assert got[8, "clean.org", ""] == got[14, "good.org", "/"] == (None, "allow")
    assert got[9, "", ""] == got[10, "", ""] == got[11, "a.com", ""] == (None, "allow")
    assert got[12, "xexample.com", "/en/"] == ("com/", "allow")
    assert got[13, "net", "/fr/"] == ("net/fr/", "block")
    assert got[None, "b.net", "/fr"] == (None, "block")


def test_sql_gives_the_same_and_empty_tables_pass(spark):
    rows = [(i, f"http://h{i % 17}.d{i % 5}.{'net' if i % 3 else 'org'}/{'es' if i % 7 else 'de'}/{i}", f'<a href="http://h{i * 5 % 17}.d{i * 3 % 5}.net/x">') for i in range(300)]
    df = pages(spark, rows)
    mine = sorted(map(repr, map(tuple, url_graph.judge_pages(df).select("page_id", "host", "path", "rule", "verdict").collect())))
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url", "html").toPandas())
    assert mine == sorted(map(repr, con.execute(url_graph.judge_sql()).fetchall()))
    assert url_graph.judge_pages(pages(spark, [])).count() == 0
