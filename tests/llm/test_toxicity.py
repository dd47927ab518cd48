import random

import numpy as np

from sievewatch.llm import toxicity

CLASHES = "label part fold _tox row score id"


def plain_segments(scores):
    out = []

    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (found is None or total > found[0] + 1e-9):
                    found = (total, i, j + 1)
        if found:
            out.append(round(found[0], 6))
            best(a, found[1])
            best(found[2], b)

    best(0, len(scores))
    return sorted(out)


def test_segments_match_the_recursive_definition():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = rng.normal(-0.2, 1, rng.integers(1, 25))
        assert sorted(round(s, 6) for s, _, _ in toxicity.segments(scores)) == plain_segments(scores)


def corpus(n=600):
    rng = random.Random(4)
    plain, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["vile", "rotten", "foulmouth", "nasty"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 200))
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.sample(bad, 3)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark, make_docs):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (None, "vile rotten nasty"), (0, rows[0][1]), (9002, "vile " * 30_000)]
    truth = dict(labels)
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(make_docs(rows, CLASHES), table).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.id in truth]
    assert len(held) > 50
    assert sum((r.score >= 0.3) == bool(truth[r.id]) for r in held) >= 0.97 * len(held)
    by_id = {r.id: r for r in got}
    assert by_id[9000].score == by_id[9001].score < 0.3
    assert all(r.score == by_id[0].score for r in got if r.id == 0)
    first = by_id[6].passages[0]
    assert 3 <= first["last"] - first["first"] + 1 <= 12


def test_rejection_keeps_clean_rows_and_columns(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs(rows, CLASHES)
    kept = toxicity.reject_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, t in labels if not t}
    assert len(clean - ids) <= 3 and len(ids - clean) <= 3


def test_empty_tables_and_single_class(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(make_docs([]), none).count() == 0
    got = toxicity.toxicity_scores(make_docs([(1, "a b"), (2, None)]), none).collect()
    assert [r.score < 0.01 for r in got] == [True, True]


def test_passages_are_found_after_single_mentions_and_again(spark, make_docs):
    rows, labels = corpus()
    rng = random.Random(9)
    plain = [w for w in " ".join(t for i, t in rows if i % 6).split()]
    bad = ["vile", "rotten", "foulmouth", "nasty"]
    words = rng.choices(plain, k=20_000)
    for n in range(40):  # each word singly, again and again
        words[n * 250 + 100] = bad[n % 4]
    words[15_000:15_000] = bad * 2
    words += bad * 2
    rows.append((9003, " ".join(words)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_scores(make_docs(rows), table).where("id = 9003").first()
    for first in (15_000, len(words) - 8):
        assert any(p["first"] <= first and first + 3 <= p["last"] <= first + 7 for p in got.passages)
    assert got.score >= toxicity.THRESHOLD


def test_counts_reach_the_driver_without_empty_buckets(spark):
    from sievewatch.llm import toxicity

    texts = spark.createDataFrame([("red blue red", 0), ("blue", 1)], "text string, part int")
    buckets, counts = toxicity._counted(texts, 2)
    assert counts.shape == (2, len(buckets)) and len(buckets) <= 10 and (buckets[1:] > buckets[:-1]).all()
    at = buckets.tolist().index(toxicity.level(b"red", 0))
    assert counts[:, at].tolist() == [2, 0]


def test_counts_are_handed_on_once_a_task():
    import pyarrow as pa

    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    batches = [pa.RecordBatch.from_pydict({"text": [" ".join(name(i) for i in range(a, a + 210_000)), None], "part": [0, 1]}) for a in (0, 100_000)]
    got = list(toxicity._counter(2, None)(iter(batches)))
    assert len(got) == 1 and got[0].column("bucket").to_numpy().tolist() == np.unique(got[0].column("bucket").to_numpy()).tolist()
    assert sum(got[0].column("g0").to_pylist()) == 420_000 * 5 and not any(got[0].column("g1").to_pylist())


def plain_score(model, token):
    share = model.base
    for bucket in [toxicity.level(token, k) for k in (*toxicity.STEMS, 0)]:
        for at in np.nonzero(model.buckets == bucket)[0]:
            toxic, clean, weight = float(model.toxic[at]), float(model.clean[at]), float(model.weight[at])
            share = (toxic + weight * share) / (toxic + clean + weight)
    return np.float32(np.log(share / (1 - share)) - np.log(model.base / (1 - model.base)) - toxicity.STEP)


def plain_scan(model, text):
    words = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).encode().split(b" ")
    words = [w for w in words if w]
    values, places, total = [plain_score(model, w) for w in words], {}, 0.0
    for at, word in enumerate(words):
        if values[at] > 0:
            if total <= 0:
                places, total = {}, 0.0
            if at - places.get(word, -1000) <= toxicity.LOCAL:
                values[at] = np.float32(-toxicity.STEP)
            places[word] = at
        total += float(values[at])
    return len(words), toxicity.segments(np.array(values, np.float32))


def test_pieces_of_texts_are_scanned_like_single_tokens(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    words = ["vile", "rotten", "Rottenest", "ΟΔΟΣ", "näher", "plain", "word", "vi", "x" * 300, "plains"]
    seen = sorted({toxicity.level(w.lower().encode(), k) for w in words[:6] for k in (*toxicity.STEMS, 0)})
    draw = np.random.default_rng(3)
    toxic, clean = draw.integers(1, 40, len(seen)).astype(np.float64), draw.integers(0, 30, len(seen)).astype(np.float64)
    model = toxicity.LogOdds(np.array(seen), clean.astype(np.float32), toxic.astype(np.float32), np.full(len(seen), 3, np.float32), 0.2)
    texts = ["", None, " 12 ", "ΟΔΟΣ", "vile" + " word" * 70 + " vile", *(rng.choice([" ", "\n", "3", " - "]).join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(40)), ""]
    want = [plain_scan(model, t or "") for t in texts]
    assert any(f for _, f in want)
    for piece, held in ((1, 3), (700, 5), (4 << 20, 200_000)):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        monkeypatch.setattr(toxicity, "HELD", held)
        got = list(toxicity._scans(pa.array(texts, pa.string()), toxicity._Scores(model)))
        assert [(m, [(a, b) for _, a, b in f]) for m, f in got] == [(m, [(a, b) for _, a, b in f]) for m, f in want]
        np.testing.assert_allclose([s for _, f in got for s, _, _ in f], [s for _, f in want for s, _, _ in f], rtol=1e-5)
