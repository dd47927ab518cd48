import hashlib
import random
import zlib

import numpy as np
import pyarrow.orc as orc
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievewatch.llm import bpe, token_files

ODD = [
    None, "", "a", "Hello world's", "it's they'RE 'S", "<|endoftext|>x<|startoftext|>", "<|endof", "ΣΑΣ ΟΔΟΣ", "İstanbul ǅ", "café e<|endoftext|>́",
    "a b c\u0085d\x1ce\x1d", "١٢٣ ²½", "日本語テキスト 한국어", "😀😀👍🏽", "a" * 33, "hahahahaha", "​zero﻿", "ﬁ ß ẞ", "\x00\x01 ab", "don't'll", "\"'s", "x" * 3000, "word " * 40_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton.from_file(public_tokenizers.path("word_bpe_49k.json"))


def samples():
    rng = random.Random(3)
    letters = [chr(c) for c in range(32, 127)] * 3 + [chr(c) for c in (*range(0xA0, 0x250), *range(0x300, 0x330), *range(0x370, 0x400), 0x2028, 0x3000, 0x1680, 0xAC00, 0x1F600, 0x4E00)]
    mixed = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000)]
    return mixed + ["".join(rng.choices("abehintor", k=rng.randint(1, 30))) for _ in range(3000)]


def test_automaton_equals_the_library(automaton, library):
    texts = [t or "" for t in ODD] + samples()
    encoder = bpe.Encoder(automaton, {})
    for text, ids, expected in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == expected.ids, text
        assert encoder.decode(ids).decode() == library.decode(expected.ids, skip_special_tokens=False)


def test_arcs_are_those_of_the_successive_construction():
    """A small vocabulary, its arc sets built gadget by gadget."""
    chars = bpe.byte_characters()
    vocab = {c + e: i for i, (c, e) in enumerate((c, e) for e in ("", "</w>") for c in chars)}
    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("a", "b</w>"), ("ba", "ba"), ("aa", "aa"), ("aab", "a")]
    for u, v in merges:
        vocab[u + v] = len(vocab)
    spec = {"model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"}, "added_tokens": [], "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": ".+"}}]}}
    built = bpe.Automaton.compile(spec)
    names = {vocab[t]: t for t in vocab}
    some = [s for s in range(len(built.ids)) if set(names[int(built.ids[s])].replace("</w>", "")) <= set("ab")]
    base = [t for t in ("a", "b", "a</w>", "b</w>")]
    arcs = {(p, w) for p in base for w in base}
    tokens = list(base)
    for u, v in merges:
        new, old = u + v, set(arcs)
        arcs.discard((u, v))
        arcs |= {(p, new) for p in tokens if (p, u) in arcs} | {(new, w) for w in tokens if (v, w) in old}
        if (v, u) in old:
            arcs.add((new, new))
        tokens.append(new)
    for p in some:
        for w in some:
            name = names[int(built.ids[p])], names[int(built.ids[w])]
            assert bool(built.exists(np.array([p]), np.array([w]))[0]) == (name in arcs), name


def test_query_columns(make_docs, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id")]
    got = bpe.bpe_tokens(make_docs(rows, "id n_tokens ids")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            expected = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
            raw = np.array(expected, "<u4").tobytes()
            assert (r.n_tokens, r.ids_sha256, list(r.ids)) == (len(expected), hashlib.sha256(raw).hexdigest(), expected)
            assert r.decoded_sha256 == hashlib.sha256(library.decode(expected, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_tokens(make_docs([])).count() == 0


@pytest.mark.parametrize("chunked", [True, False])
def test_library_encoder_equals_the_library(library, chunked):
    texts = [t or "" for t in ODD] + samples() + ["Hello, World. <|ENDOFTEXT|> a<|endoftext|>B, É.", "ª. º, ǅ. ß. ﬁ. İ. I, ,. .,", "J\u030c K\u0327"]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_files.LibraryEncoder(f.read(), {}, chunked)
    for text, ids, expected in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == expected.ids, text


def test_token_files_read_back(spark, make_docs, library, tmp_path):
    rows = [(i, t) for i, t in enumerate([*ODD, *samples()[:200]])] + [(3, ODD[3]), (None, "no id")]
    got = token_files.token_file_report(make_docs(rows, "id shard first ids").repartition(5)).collect()
    by_start = sorted(got, key=lambda r: r.start)
    ids = [r.id for r in by_start]
    assert len(got) == len(rows) and ids[0] is None and ids[1:] == sorted(ids[1:])
    texts, at = dict(rows), 0
    for r in by_start:
        expected = np.array(library.encode(texts[r.id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(expected), zlib.crc32(expected.tobytes()))
        at += len(expected)
    assert token_files.token_file_report(make_docs([])).count() == 0


def test_lookups_prune_by_id(spark, make_docs, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(make_docs([(i, f"text number {i}") for i in range(3000)]), path)
    read = token_files.read_token_files(spark, path)
    assert [r.id for r in read.where("id = 1234").collect()] == [1234]
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,1234)" in spark.read.orc(path).where("id = 1234")._jdf.queryExecution().toString()
    files = sorted(tmp_path.glob("ids/*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == 3000


def test_row_groups_are_skipped(spark, tmp_path):
    """Rows that the scan hands on: one row group by the row index, none where the Bloom filter knows the id is not there."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "ids")
    docs = spark.range(60_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("a word "), F.col("id") % 7).alias("text"))
    token_files.write_token_files(docs, path)

    def scanned(where):
        found = spark.read.schema("id long, shard int, first long, ids array<int>").orc(path).where(where)
        rows = found.collect()
        return len(rows), found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()

    assert scanned("id >= 0") == (60_000, 60_000)
    assert scanned("id = 62468") == (1, token_files.INDEX_STRIDE)
    assert scanned("id = 200000") == (0, 0)  # behind all
    assert [scanned(f"id = {i}")[1] for i in range(3, 99_999, 10_000)].count(0) >= 8  # between others, all but false positives
