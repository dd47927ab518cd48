import random

import numpy as np
import xxhash

from sievewatch.llm import simhash
from sievewatch.llm.components import connected_components, local_roots

CLASHES = "id fp class text_hash component_id row _hash"


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = local_roots(len(rows), np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return [(rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows))]


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n in range(60):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 8, 60, 400]))
        rows.append((len(rows), " ".join(base)))
        for _ in range(n % 4):  # near copies
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), "  ".join(copy).upper()))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "x" * 200_000), (904, "long " * 50_000), (5, rows[5][1]), (None, rows[7][1]), (None, "only this one has no id")]


def test_components_match_brute_force(make_docs):
    rows = corpus()
    got = simhash.simhash_components(make_docs(rows, CLASHES)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_components(rows)))


def test_one_row_of_each_class_stays_with_its_columns(make_docs):
    rows = corpus()
    docs = make_docs(rows, CLASHES)
    kept = simhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    classes = {c for _, _, c in plain_components(rows)}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == classes


def test_empty_table(make_docs):
    assert simhash.simhash_components(make_docs([])).count() == 0
    assert simhash.keep_one_per_class(make_docs([])).count() == 0


def test_trie_walk_finds_every_pair_of_a_dense_ball():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    ball = np.unique([int(centre) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(900)]).astype(np.uint64)
    found = {(int(i), int(j)) for a, b in simhash.trie_pairs(ball, None, 0, 0) for i, j in zip(a, b, strict=True)}
    assert found == {(i, j) for i in range(len(ball)) for j in range(i + 1, len(ball)) if (int(ball[i]) ^ int(ball[j])).bit_count() <= 3}
    order = [int(i) for i in rng.permutation(64)]
    assert (simhash.restore(simhash.reorder(ball, order), order) == ball).all()


def test_components_of_chains_hubs_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, i) for i in range(1001, 1300)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7), (None, 3), (1001, 1000)], "a long, b long").repartition(6)
    got = dict(connected_components(edges).collect())
    assert got == {i: 100 for i in range(101, 161)} | {i: 1000 for i in range(1001, 1300)}
