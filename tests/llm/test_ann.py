import numpy as np
import pandas as pd
import pytest

from sievewatch.llm import ann, hnsw
from sievewatch.llm.components import local_roots

SCHEMA = "vec_id long, embedding array<float>, gid string, vector string, dim string, copies string"


def corpus():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(900, 24))
    near = base[rng.integers(0, 20, 150)] + rng.normal(size=(150, 24)) * 0.05
    hot = base[5] + rng.normal(size=(200, 24)) * 0.02
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([base, near, hot, np.repeat(base[7:8], 60, axis=0)])]
    vectors += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0]]
    return list(enumerate(vectors))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in corpus()], SCHEMA).repartition(5)


def good(v):
    return v is not None and len(v) == 24 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_neighbours(table):
    rows = [(i, np.array(v, float)) for i, v in corpus() if good(v)]
    ids, m = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), 20).toPandas()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        scores = m @ m[np.searchsorted(ids, q)]
        order = [k for k in np.lexsort((ids, -scores.round(9))) if ids[k] != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine.id)
        assert np.allclose(mine.score, scores[np.searchsorted(ids, mine.id)], atol=1e-12)
        assert (mine.score.diff().dropna() <= 0).all()
        hit, total = hit + len(set(ids[order]) & set(mine.id)), total + 20
    assert hit >= 0.95 * total
    assert not set(got.query_id) - set(ids) - {1316}


def test_repeated_rows_and_ids_with_several_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 6)))]
    rows += [rows[0]] * 2 + [rows[7]] * 3 + [(20, rng.normal(size=6).tolist())]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 10).collect()
    held = {}
    for i, v in rows:
        held.setdefault(i, set()).add(tuple(v))
    for q in (0, 20, 40):
        best = {i: max(float(np.dot(a, b)) for a in held[q] for b in vs) for i, vs in held.items() if i != q}
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10]
        mine = sorted((r["rank"], r.id, r.score) for r in got if r.query_id == q)
        assert [(r, i) for r, i, _ in mine] == [(n + 1, i) for n, (i, _) in enumerate(want)]
        assert np.allclose([s for _, _, s in mine], [s for _, s in want])


def test_near_duplicates(table):
    rows = [(i, np.array(v, float)) for i, v in corpus() if good(v)]
    ids, m = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    a, b = np.nonzero(links)
    component = pd.Series(ids).groupby(local_roots(len(ids), a, b)).transform("min").to_numpy()
    got = ann.near_duplicates(table).toPandas().set_index("id")
    assert len(got) == len(corpus())
    mine = got.loc[ids]
    assert (mine.n_links.to_numpy() <= links.sum(axis=1)).all()
    assert mine.n_links.sum() >= 0.98 * links.sum()
    assert (mine.component_id.to_numpy() == component).mean() >= 0.98
    rest = got.loc[[i for i, v in corpus() if not good(v)]]
    assert (rest.n_links == 0).all() and (rest.component_id == rest.index).all() and rest.kept.all()


def test_a_link_found_from_one_end_counts_for_both(spark, monkeypatch):
    """Every second query of a shard finds nothing, so half of the links are known from one end or none."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 16))
    vectors = np.concatenate([base, base + rng.normal(size=base.shape) * 0.03])
    whole = ann._links

    def deaf(graph, unit, asked, beam, threshold, scanned=None):
        for row, node in whole(graph, unit, asked, len(unit), threshold):
            ok = row % 2 == 0
            yield row[ok], node[ok]

    monkeypatch.setattr(ann, "_links", deaf)
    monkeypatch.setattr(ann, "_passes", lambda *a: True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.id: (r.n_links, r.component_id) for r in ann.near_duplicates(df).collect()}
    linked = [i for i in range(400) if got[400 + i][1] == i]
    assert 200 < len(linked) < 400
    assert all(got[i] == (1, i) and got[400 + i] == (1, i) for i in linked)
    assert sum(n for n, _ in got.values()) == 2 * len(linked)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(empty, empty, 20).count() == 0
    assert ann.near_duplicates(empty).count() == 0


def test_beam_widens_until_the_audit_passes(monkeypatch, table):
    monkeypatch.setattr(ann, "BEAM", 1)
    got = ann.near_duplicates(table)
    assert got.where("n_links >= 200").count() >= 195


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_graph_of_any_size(n):
    vectors = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ids, near = hnsw.search(hnsw.build(vectors), vectors, 32)
    assert (ids[:, 0] == np.arange(n)).mean() >= 0.99
    assert near.shape == (n, min(n, 32))


def test_hot_links_do_not_hide_lost_pairs_in_the_audit():
    rng = np.random.default_rng(12)
    single, hot = rng.normal(size=(6000, 32)), rng.normal(size=32) + rng.normal(size=(3000, 32)) * 0.05
    pairs = single[:300] + rng.normal(size=(300, 32)) * 0.15
    unit = ann._unit(np.concatenate([single, hot, pairs]))
    gids = np.arange(len(unit))
    graph = hnsw.build(unit)
    graph.layers[0][6000:9000][np.isin(graph.layers[0][6000:9000], np.arange(6000))] = -1
    graph.layers[0][graph.layers[0] >= 9000] = -1  # no way leads to the second of a pair

    def recall(beam):
        found = {(int(r), int(n)) for row, node in ann._links(graph, unit, unit[:300], beam, 0.9) for r, n in zip(row, node, strict=True)}
        return len(found & {(i, 9000 + i) for i in range(300)}) / 300

    real = ((unit[:300] * unit[9000:]).sum(axis=1) >= 0.9).mean()
    assert real > 0.9 and recall(64) < 0.5
    some = unit[ann._sample(len(unit))]  # over all links of all queries, own nodes with them, nothing seems to be lost
    assert sum(len(r) for r, _ in ann._links(graph, unit, some, 64, 0.9)) >= 0.98 * (some @ unit.T >= 0.9).sum()
    audit = ann._audit(unit, gids, unit, gids, 0.9)
    assert (audit[2] == 1).sum() > 100
    assert not ann._passes(graph, unit, audit, 64, 0.9)
    assert recall(4096) >= 0.98 * real and ann._passes(graph, unit, audit, 4096, 0.9)


def test_one_miss_counts_once():
    exact = -np.sort(-np.random.default_rng(2).normal(size=(4, 21)), axis=1)
    found = np.concatenate([exact[:, 1:], exact[:, -1:] - 1], axis=1)  # the nearest of 21 is missing
    assert ann._recall(found, exact) == pytest.approx(20 / 21)
    assert ann._recall(exact, exact) == 1


def test_beams_have_no_node_twice():
    vectors = np.random.default_rng(4).normal(size=(700, 12)).astype(np.float32)
    ids, near = hnsw.search(hnsw.build(vectors), vectors[:50], 128)
    assert all(len(set(row)) == 128 and min(row) >= 0 for row in ids.tolist())
    assert np.allclose(near, (vectors[ids] * vectors[:50, None]).sum(axis=2), atol=1e-5) and (np.diff(near, axis=1) <= 0).all()
    best = np.argsort(-(vectors[:50] @ vectors.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(best.tolist(), ids.tolist(), strict=True)]) >= 19
