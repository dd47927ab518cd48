"""Byte-pair encoding with a tokenization automaton, and decoding by its arc labels.

The automaton has one state per token: the state after a path is the path's last token, and a path is the encoding of
the bytes on it exactly if every arc on it exists. It is built by one merge gadget per rule, in rule order. The gadget
for u v -> w removes the arc v from state u, gives state w the arcs that v has just then, and gives every state that
has the arc u just then the arc w. A dense table would hold 49,408 x 49,408 arcs, so the gadgets are kept as what they
copy from and when, and an arc is looked up by following copies back to single bytes; arcs once found stay in a table.

Encoding walks all words of a batch at once: a trie spells the arcs that leave each position, and the arcs that exist
from the one state reached there lead on. Each position of a word is reached by exactly one path, so the walk has no
choices to undo. Words come from the tokenizer's own pre-split and are encoded once per batch of texts and remembered by
the worker up to a limit.

Defined cases: null and empty texts have no ids and decode to an empty string; repeated rows are encoded alike; the
strings of the special tokens in a text become those tokens, as in the tokenizers library; very long words are walked
like short ones; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewatch.llm.common import lean, text_batches, text_of, worker_store

TOKENIZER = "word_bpe_49k.json"
#: Bytes of text encoded at a time, and entries remembered for chunks and words.
GROUP_BYTES = 2 << 20
REMEMBERED = 80_000
#: Words walked at a time.
WALK = 1 << 15
SYMBOLS = 512


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Table:
    """Sorted long keys with int values; keys that are missing give the default."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int):
        order = np.argsort(keys)
        self.keys, self.values, self.default = keys[order], values[order], default

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.default, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.default)


class _Found:
    """Arcs looked up before, one per slot; a later arc takes the slot of an earlier one."""

    def __init__(self, slots: int = 1 << 20):
        self.keys, self.values = np.full(slots, -1, np.int64), np.zeros(slots, np.int8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % len(self.keys)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        return np.where(self.keys[at] == keys, self.values[at], np.int8(-1)).astype(np.int32)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._slot(keys)
        at, first = np.unique(at, return_index=True)
        self.keys[at], self.values[at] = keys[first], values[first]


@dataclass
class Automaton:
    ids: np.ndarray  # token id of each state
    left: np.ndarray  # the gadget's u and v, -1 for single bytes
    right: np.ndarray
    time: np.ndarray  # when the gadget was applied, -1 for single bytes
    removed: _Table  # (state, arc) -> when a gadget removed it
    arcs: _Table  # (trie node, symbol) -> trie node
    spelt: np.ndarray  # trie node -> state or -1
    labels: dict[int, bytes]
    special: dict[str, int]
    pattern: str
    known: _Found = field(default_factory=lambda: _Found())

    @classmethod
    def compile(cls, spec: dict) -> Automaton:
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        state_of, spelling, ids, left, right, time = {}, [], [], [], [], []
        for symbol in range(SYMBOLS):  # a byte, or a byte that ends a word
            token = byte_characters()[symbol % 256] + end * (symbol >= 256)
            state_of[token] = symbol
            spelling.append((symbol,))
            ids.append(vocab[token])
            left.append(-1)
            right.append(-1)
            time.append(-1)
        gone_key, gone_at = [], []
        for at, (u, v) in enumerate(model["merges"]):
            a, b = state_of[u], state_of[v]
            if time[a] >= at or time[b] >= at or u + v in state_of:
                raise ValueError("merge rules must build each token once, after its parts")
            state_of[u + v] = len(ids)
            spelling.append(spelling[a] + spelling[b])
            ids.append(vocab[u + v])
            left.append(a)
            right.append(b)
            time.append(at)
            gone_key.append(a << 32 | b)
            gone_at.append(at)
        nodes: dict[int, int] = {}
        spelt = [-1]
        for state, symbols in enumerate(spelling):
            node = 0
            for s in symbols:
                key = node * SYMBOLS + s
                if key not in nodes:
                    nodes[key] = len(spelt)
                    spelt.append(-1)
                node = nodes[key]
            spelt[node] = state
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: t.encode() for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        as_array = lambda x: np.array(x, dtype=np.int32)
        return cls(
            as_array(ids), as_array(left), as_array(right), as_array(time),
            _Table(np.array(gone_key, np.int64), as_array(gone_at), 1 << 30),
            _Table(np.fromiter(nodes.keys(), np.int64), np.fromiter(nodes.values(), np.int32), -1),
            as_array(spelt), labels, special, split,
        )

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            return cls.compile(json.load(f))

    def exists(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """Whether each state has each arc."""
        keys, back = np.unique(state.astype(np.int64) << 32 | arc, return_inverse=True)
        found = self.known.get(keys)
        new = found < 0
        if new.any():
            fresh = keys[new]
            found[new] = self._follow((fresh >> 32).astype(np.int32), (fresh & 0xFFFFFFFF).astype(np.int32))
            self.known.put(fresh, found[new])
        return found[back] == 1

    def _follow(self, p: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Follow gadgets back: the arc is there at a time unless removed before, or missing where it was copied from."""
        out = np.ones(len(p), np.int32)
        before = np.full(len(p), len(self.ids), np.int64)
        live = np.arange(len(p))
        while len(live):
            gone = self.removed.get(p.astype(np.int64) << 32 | w) < before
            out[live[gone]] = 0
            tp, tw = self.time[p], self.time[w]
            on = ~gone & ((tp >= 0) | (tw >= 0))
            live, p, w, tp, tw = live[on], p[on], w[on], tp[on], tw[on]
            newer_arc, newer_state = tw > tp, tp > tw
            same = ~newer_arc & ~newer_state  # a state and its own arc
            # an arc's copy is taken after its gadget's removal, a state's copy before it
            before = np.where(newer_arc, tw + 1, tp)
            p, w = np.where(newer_state | same, self.right[p], p), np.where(newer_arc | same, self.left[w], w)
        return out

    def walk(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            most = max(8, int(sizes[order[at]]) * 5 // 4)  # words of similar length go together
            to = min(at + max(1, WALK * 16 // most), int(np.searchsorted(sizes[order], most, side="right")))
            part = order[at:to]
            for w, ids in zip(part.tolist(), self._walk([words[w] for w in part.tolist()]), strict=True):
                out[w] = ids
            at = to
        return out

    def _walk(self, words: list[bytes]) -> list[bytes]:
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        symbols = np.zeros((n, width), np.int64)
        symbols[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        symbols[np.arange(n), sizes - 1] += 256
        last = np.full((n, width + 1), -1, np.int32)  # the state reached at each position
        size = np.zeros((n, width + 1), np.int32)  # bytes of the arc that reached it
        for start in range(width):
            row = np.nonzero((sizes > start) & ((last[:, start] >= 0) | (start == 0)))[0]
            node = np.zeros(len(row), np.int64)
            held_row, held_arc, held_end = [], [], []
            end = start
            while len(row):
                node = self.arcs.get(node * SYMBOLS + symbols[row, end])
                end += 1
                on = node >= 0
                row, node = row[on], node[on]
                arc = self.spelt[node]
                held_row.append(row[arc >= 0])
                held_arc.append(arc[arc >= 0])
                held_end.append(np.full(len(held_row[-1]), end))
                more = sizes[row] > end
                row, node = row[more], node[more].astype(np.int64)
            if held_row:
                rows, arcs, ends = np.concatenate(held_row), np.concatenate(held_arc), np.concatenate(held_end)
                if start:
                    good = self.exists(last[rows, start], arcs)
                    rows, arcs, ends = rows[good], arcs[good], ends[good]
                last[rows, ends] = arcs
                size[rows, ends] = ends - start
        # read the paths backwards, all words in step
        at, row, steps = sizes.copy(), np.arange(n), []
        while len(row):
            state = last[row, at[row]]
            steps.append((row, self.ids[state]))
            step = size[row, at[row]]
            if not step.all():
                raise RuntimeError("a word has no path")
            at[row] -= step
            row = row[at[row] > 0]
        rows, ids = np.concatenate([r for r, _ in steps][::-1]), np.concatenate([i for _, i in steps][::-1])
        by = np.argsort(rows, kind="stable")
        flat = ids[by].astype("<u4").tobytes()
        cuts = (np.cumsum(np.bincount(rows, minlength=n)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


class Encoder:
    """Texts to ids, with what the worker remembers of chunks (between white space) and words (of the pre-split)."""

    def __init__(self, automaton: Automaton, store: dict):
        self.automaton = automaton
        self.chunks: dict[bytes, bytes] = store.setdefault("chunks", {})
        self.words: dict[bytes, bytes] = store.setdefault("words", {})
        if "known" in store:
            automaton.known = store["known"]
        self.store = store
        self.split = regex.compile(automaton.pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, automaton.special)) + ")") if automaton.special else None

    def _words_of(self, text: str) -> list[bytes]:
        """The words of a piece of text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            return [w.encode() for w in self.split.findall("".join(map(str.lower, text)))]  # case is changed letter by letter
        text = text.lower()
        return [text.encode()] if text.isalpha() else [w.encode() for w in self.split.findall(text)]

    def _parts(self, chunk: bytes) -> list[bytes | int]:
        """Words and ids of special tokens."""
        text = chunk.decode()
        if self.special is None or "<|" not in text:
            return self._words_of(text)
        out: list[bytes | int] = []
        for piece in self.special.split(text):
            known = self.automaton.special.get(piece)
            out.extend(self._words_of(piece) if known is None else [known])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.encode().split() for t in texts]
        new = {c for chunks in split for c in chunks}.difference(self.chunks)
        if new:
            if len(self.chunks) > REMEMBERED:
                self.chunks.clear()
                new = {c for chunks in split for c in chunks}
            if len(self.words) > REMEMBERED:
                self.words.clear()
            parts = {c: self._parts(c) for c in new}
            unseen = list({w for p in parts.values() for w in p if isinstance(w, bytes)}.difference(self.words))
            self.words.update(zip(unseen, self.automaton.walk(unseen), strict=True))
            self.store["known"] = self.automaton.known
            for chunk, held in parts.items():
                self.chunks[chunk] = b"".join(self.words[w] if isinstance(w, bytes) else w.to_bytes(4, "little") for w in held)
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in split]

    def decode(self, ids: bytes) -> bytes:
        """Arc labels of the path, put together as the library does without a decoder: with a space between tokens."""
        return b" ".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def grouped(texts: Iterable[str], most: int = GROUP_BYTES) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _runner(shared, name: str, with_ids: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, worker_store(f"bpe-{name}"))
        for batch in batches:
            at = 0
            for texts in grouped(t.as_py() for t in batch.column(1)):  # results go back in batches of this size
                ids = encoder.encode(texts)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in made]) for made in (ids, map(encoder.decode, ids))]
                columns, names = [batch.column(0).slice(at, len(ids)), pa.array(sizes), *digests], ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(ids)

    return run


def bpe_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row. The automaton is read on the driver and broadcast:
    its size is the vocabulary's."""
    text_batches(docs.sparkSession)
    path = path or public_tokenizers.path(TOKENIZER)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.from_file(path))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return slim.mapInArrow(lean(_runner(shared, path, with_ids)), schema).withColumnRenamed("id", id_col)
