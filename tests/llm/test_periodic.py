import hashlib
import random
import zlib

import numpy as np

from sievewatch.llm import periodic, queries

CLASHES = "id runs collapsed n_words row"


def plain_runs(words):
    """Maximal stretches by definition: every period, and of each long enough stretch every smaller period."""
    n, out = len(words), []
    numbers = np.unique(np.array([str(w) for w in words]), return_inverse=True)[1] if n else np.empty(0, int)
    for q in range(1, n // 4 + 1):
        edge = np.diff(np.concatenate([[0], numbers[:-q] == numbers[q:], [0]]).astype(int))
        for i, j in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True):
            part = numbers[i: j + q]
            if len(part) >= max(6, 4 * q) and not any((part[p:] == part[:-p]).all() for p in range(1, q)):
                out.append((i, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(words):
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_random_words_match_the_definition():
    rng = random.Random(8)
    docs = []
    for n in range(500):
        alphabet = "ab" if n % 3 else "abcde"
        doc = rng.choices(alphabet, k=rng.choice([0, 1, 5, 6, 7, 30, 90]))
        for _ in range(n % 4):
            block = rng.choices(alphabet, k=rng.randint(1, 9))
            doc += block * rng.randint(2, 9) + block[: rng.randint(0, len(block))]
        docs.append(doc)
    docs += [["a"] * 200, list("ab" * 70), list("aab" * 40 + "aab" * 3 + "c"), list(("a" * 8 + "b") * 9), list((("ab" * 5 + "c") * 4 + "d") * 5)]
    ends = np.cumsum([len(d) for d in docs])
    words = np.array([ord(w) for d in docs for w in d], np.int64)
    start, length, period = periodic.find_runs(words, ends)
    own = np.searchsorted(ends, start, side="right")
    base = ends - np.diff(ends, prepend=0)
    got = [[] for _ in docs]
    for d, s, n, q in zip(own.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got[d].append((s - int(base[d]), n, q))
    assert [sorted(g, key=lambda r: (r[0], r[2])) for g in got] == [plain_runs(d) for d in docs]
    assert sum(map(len, got)) > 500


def test_report_of_odd_rows(make_docs):
    long_line = "la " * 150_000
    rows = [
        (1, "x y\tx y\nx y x y z"), (2, None), (3, ""), (4, " \t "), (5, "a a a a a"), (6, "a a a a a a"), (6, "a a a a a a"), (None, "b b b b b b b"),
        (7, "Ä ä Ä ä Ä ä Ä ä"), (8, "no break no break no break no break no break no break"), (9, "q w e " * 4 + "q q q q q q q"),
    ]
    got = periodic.run_report(periodic.periodic_runs(make_docs(rows, CLASHES))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *plain_row((t or "").encode().split()))) for i, t in rows)
    (row,) = periodic.run_report(periodic.periodic_runs(make_docs([(1, long_line)]))).collect()
    assert tuple(row)[1:6] == (1, 0, 150_000, 1, 150_000_000)


def test_runs_and_collapsed_text_are_returned(make_docs):
    (row,) = periodic.periodic_runs(make_docs([(1, "say it it it it it it now")])).collect()
    assert row.n_words == 8 and [tuple(r) for r in row.runs] == [(1, 6, 1)] and row.collapsed == "say it now"


def test_empty_table(make_docs):
    assert periodic.run_report(periodic.periodic_runs(make_docs([]))).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 20_000]
    expected = {i: plain_row(planted(i, (t or "").encode().split())) for i, t in docs}
    got = {r[0]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert {i: got[i] for i in expected} == expected
    assert any(r[0] for r in got.values())
