import random

import corpus_pipeline
import numpy as np

from sievewatch.llm import near_dedup
from sievewatch.llm.components import local_roots

CLASHES = "id node class text_hash size band bands component"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = local_roots(len(rows), np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
    return sorted(min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=-1) for r in set(root))


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for n in range(40):
        base = rng.choices(words, k=rng.choice([1, 3, 5, 6, 40, 100, 100, 400]))
        rows.append((len(rows), " ".join(base)))
        for k in range(n % 4):  # near copies with 1, 2 or 3 words changed
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(len(copy), k + 1)):
                copy[at] = f"changed{n}x{k}"
            rows.append((len(rows), "  ".join(copy).upper()))
    hot = rng.choices(words, k=120)
    for n in range(80):  # one group, linked in chains and not
        copy = list(hot)
        for at in rng.sample(range(len(copy)), 1 + n % 5):
            copy[at] = f"hot{n}"
        rows.append((len(rows), " ".join(copy)))
    long = rng.choices(words, k=150)
    for n in range(120):  # copies of one text, most of them changed too much to be linked with each other or with it
        copy = [w if n == 60 or rng.random() > 0.001 * n else f"far{n}x{i}" for i, w in enumerate(long)]
        rows.append((len(rows), " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "x" * 200_000), (904, "long " * 50_000), (5, rows[5][1]), (None, rows[7][1]), (None, "only this one has no id")]


def test_the_stage_keeps_one_of_each_class_at_similarity_0_8(spark, make_docs):
    rows = corpus()
    docs = make_docs(rows, CLASHES)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_one_changed_word_of_a_hundred_is_a_near_copy(spark, make_docs):
    words = [f"w{i}" for i in range(100)]
    rows = [(n, " ".join(words[:k] + ["other"] + words[k + 1:])) for n, k in enumerate((10, 30, 50, 70, 90))] + [(9, " ".join(words))]
    assert [r.doc_id for r in near_dedup.keep_one_per_class(make_docs(rows)).collect()] == [0]


def test_empty_table(make_docs):
    assert near_dedup.keep_one_per_class(make_docs([])).count() == 0


def test_the_trie_of_fingerprints_proposes_the_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    sets = [near_dedup.shingle_set(" ".join(words[:k] + ["other"] * (k > 0) + words[k + 1:])) for k in (0, 40, 300)]
    sets.append(near_dedup.shingle_set(" ".join(f"v{i}" for i in range(400))))
    fps = np.array([near_dedup.fingerprint(s) for s in sets], np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([*enumerate(fps), (7, fps[3])], "node long, fp long")
    scratch = near_dedup.Scratch(spark, "test-trie")
    found = {tuple(r) for r in near_dedup._trie_candidates(nodes, scratch).collect()}
    near = [(i, j) for j in range(4) for i in range(j) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 3]
    scratch.drop()

    def classes(pairs):
        ends = [np.array([p[k] for p in pairs], np.int64) for k in (0, 1)]
        return local_roots(8, *ends).tolist()

    assert near and classes(found) == classes([*near, (3, 7)])
