import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sievewatch.llm import suffix_dedup
from sievewatch.llm.bwt import repeated_starts

CLASHES = "id s e spans row anchor no_text"


def plain(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i: i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for (key, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i: i + least]] > 1:
                gone[i: i + least] = True
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((key, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def corpus(least):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = text(2 * least), text(least)
    rows = [(i, text(rng.randint(0, 4 * least))) for i in range(30)]
    rows += [(100 + i, text(rng.randint(0, least)) + passage[i: i + least + 5 * i] + text(rng.randint(0, least))) for i in range(12)]
    rows += [(200, other * 3), (201, "ab" * least), (202, "ab" * (least // 2)), (203, None), (204, ""), (205, other[:-1])]
    rows += [(3, rows[3][1]), (None, passage), (None, None), (300, text(60 * least) + passage)]
    near = text(3 * least)
    return rows + [(400 + i, near[:i * 7] + "#" + near[i * 7:]) for i in range(25)]


@pytest.mark.parametrize("least", [40, 400])
def test_removal_matches_brute_force(make_docs, least):
    rows = corpus(least)
    got = suffix_dedup.removal_report(make_docs(rows, CLASHES), least=least).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, least)))


def test_split_groups_give_the_same(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(suffix_dedup, "TRANSFORM", 500)
    rows = corpus(40)
    got = suffix_dedup.removal_report(make_docs(rows), least=40).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, 40)))


def test_rewritten_texts_keep_columns_and_nulls(make_docs):
    rows = corpus(40)
    docs = make_docs(rows, CLASHES)
    got = suffix_dedup.remove_repeats(docs, least=40)
    assert got.columns == docs.columns
    assert got.count() == len(rows)
    assert {r.doc_id: r.text for r in got.collect()}[203] is None
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0
    assert suffix_dedup.removal_report(make_docs([])).count() == 0


def test_interval_expansion_on_random_strings():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, kinds, least = int(rng.integers(1, 300)), int(rng.integers(1, 4)), int(rng.integers(1, 12))
        symbols = rng.integers(1, 1 + kinds, n).astype(np.uint16)
        symbols[rng.random(n) < 0.05] = 0
        symbols = np.append(symbols, np.uint16(0))
        strings = [tuple(symbols[i: i + least]) if i + least <= len(symbols) and symbols[i: i + least].all() else None for i in range(len(symbols))]
        seen = Counter(strings)
        assert repeated_starts(symbols, least).tolist() == [s is not None and seen[s] > 1 for s in strings]


def test_occurrences_are_found_once(spark, monkeypatch):
    seen, write = [], suffix_dedup.Scratch.stage
    monkeypatch.setattr(suffix_dedup.Scratch, "stage", lambda self, df, tag: seen.append((tag, df._jdf.queryExecution().executedPlan().toString())) or write(self, df, tag))
    suffix_dedup.repeated_spans(spark.createDataFrame([(1, "abcdefgh" * 80), (2, "abcdefgh" * 90)], "doc_id long, text string"))
    assert [tag for tag, plan in seen if "MapInArrow" in plan or "PythonMapInArrow" in plan] == ["occurrences"]
