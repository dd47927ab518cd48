"""Every registered query on the smallest tables, against the SQL that goes with it."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    try:
        return round(float(v), 6) + 0.0
    except (TypeError, ValueError):
        return str(v)


def order(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def test_entry_runs(spark):
    assert len(entry.entry(spark).take(1)) == 1


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=order)
    if name not in entry.oracle_sql():
        assert got
        return
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=order)
    assert got == want
