"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

1. Tokens are counted in hashed buckets (a fixed number): first those of label 1, then, in the buckets these fill, those
   of label 0 and of every other document. Log-odds use a chain of Dirichlet priors: the share over all tokens is the centre for a token's first four bytes, theirs the
   centre for its first five, and so on to the token itself. A prior weighs more for what is frequent in the corpus.
2. All maximal scoring segments of a document are found in one linear scan (Ruzzo and Tompa).
3. The best score of a clean document of m tokens follows a Gumbel law, P(S >= x) = 1 - exp(-K m exp(-lambda x)).
   lambda and K are fitted by maximum likelihood on rows that the counts have not seen; the significant segments of a
   document are added up in units of that law, and a logistic curve turns the sum into a probability.

Only rows that ``train_fold`` allows are learnt from, at most ``MAX_LABELLED`` of them (in order of a hash of the id), so
that they can be broadcast; the prior covers every document. What reaches the driver is one row per bucket and at most
``MAX_CALIBRATION`` calibration rows.

Defined cases: a null or empty text has no tokens and gets the score of a document without any toxic sign; with no
labels, or labels of one class only, the score is the share of label 1 (0 without labels); repeated rows are scored
alike; a row with a null id has no label and counts as not held out; an empty table gives no rows; further columns
(lang, source) are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import astuple, dataclass
from itertools import pairwise
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewatch.llm.common import lean, stage, text_batches, text_of

THRESHOLD = 0.3
BUCKETS = 1 << 21
MAX_LABELLED = 100_000
MAX_CALIBRATION = 20_000
#: Weight of the prior in tokens: for any bucket, and as a share of what the corpus frequency lets expect.
PRIOR, CORPUS = 3.0, 0.1
#: Lengths in bytes of the beginnings that a token's prior is built from.
STEMS = (4, 5, 6, 7)
#: Cost of a token, so that segments end where nothing speaks for them.
STEP = 0.3
#: Tokens within which a token that comes again is no new evidence.
LOCAL = 64
#: Scores of tokens remembered by a task.
HELD = 200_000
#: Characters of text taken at a time, unless one document is longer, and tokens counted before counts are handed on.
PIECE = 4 << 20
COUNTED = 1 << 30

_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens of the texts, which of them stands at each place of all texts, and the place where each text ends.

    Tokens are runs of letters, lower-cased; digits, punctuation and white space of ASCII separate.
    """
    parts = [text.lower().encode("utf-8", "surrogatepass") for text in texts]
    whole = b" ".join([b"", *parts, b""]).translate(_KEEP)
    letter = np.frombuffer(whole, np.uint8) != 32
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    ends = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1))
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(whole.replace(b" ", b""))]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), ends


def level(token: bytes, k: int) -> int:
    """Bucket of the token's first ``k`` bytes; of the whole token if ``k`` is 0."""
    return zlib.crc32(token[:k] if k else token, k) % BUCKETS


def levels(words: list[bytes]) -> list[np.ndarray]:
    """Buckets of the tokens' first bytes, the shortest first, and of the tokens."""
    heads = [[zlib.crc32(word[:k], k) for word in words] for k in STEMS]
    return [np.array(crc, np.int64) % BUCKETS for crc in (*heads, list(map(zlib.crc32, words)))]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about PIECE characters, each with the row it begins at; null counts as empty."""
    first, held, size = 0, [], 0
    for row, text in enumerate(texts):
        held.append(str(text.as_py() or ""))
        size += len(held[-1])
        if size >= PIECE:
            yield first, held
            first, held, size = row + 1, [], 0
    if held:
        yield first, held


def _counter(groups: int, known: Broadcast | None) -> Callable:
    """Rows (text, group) -> (bucket, one count per group); with ``known``, only of the buckets marked there."""

    def rows(sums: np.ndarray) -> pa.RecordBatch:
        seen = sums.any(axis=0)
        if known is not None:
            seen &= np.unpackbits(known.value).astype(bool)
        seen = np.nonzero(seen)[0]
        return pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(sums[i, seen]) for i in range(groups))], names=["bucket", *(f"g{i}" for i in range(groups))])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros((groups, BUCKETS), np.int32), 0
        for batch in batches:
            parts = batch.column(1).to_numpy()
            for first, texts in _pieces(batch.column(0)):
                words, at, ends = words_of(texts)
                if held and held + len(at) > COUNTED:
                    yield rows(sums)
                    sums, held = np.zeros((groups, BUCKETS), np.int32), 0
                held += len(at)
                group = np.repeat(parts[first: first + len(texts)], np.diff(ends, prepend=0))
                buckets = levels(words)
                for i in range(groups):
                    n = np.bincount(at[group == i], minlength=len(words)).astype(np.int32)
                    some = np.flatnonzero(n)
                    for bucket in buckets:
                        np.add.at(sums[i], bucket[some], n[some])
        if held:
            yield rows(sums)

    return count


def _counted(texts: DataFrame, groups: int, known: Broadcast | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in order and their counts (groups x buckets) of rows (text, part: 0 to groups - 1); at most BUCKETS rows reach the driver."""
    names = [f"g{i}" for i in range(groups)]
    rows = texts.mapInArrow(lean(_counter(groups, known)), "bucket int, " + ", ".join(f"{n} int" for n in names))
    got = rows.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    order = np.argsort(got.column("bucket").to_numpy())
    return got.column("bucket").to_numpy()[order].astype(np.int64), np.stack([got.column(n).to_numpy()[order].astype(np.float64) for n in names])


@dataclass
class LogOdds:
    """Buckets that label 1 has, in order, with the counts of both labels and the prior's weight; label 1's share of these."""

    buckets: np.ndarray
    clean: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    base: float

    @classmethod
    def fit(cls, buckets: np.ndarray, corpus: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> LogOdds:
        labelled = clean.sum() + toxic.sum()
        weight = PRIOR + CORPUS * labelled * corpus / max(1.0, corpus.sum())
        base = min(0.5, max(1e-6, toxic.sum() / max(1.0, labelled)))
        at = np.nonzero(toxic)[0]
        return cls(buckets[at], *(x[at].astype(np.float32) for x in (clean, toxic, weight)), float(base))

class _Scores(dict):
    """Token -> log-odds of its share of label 1 against the share of all tokens, less the cost of a token; worked out at first sight.

    Each level is the centre of the next one's prior; a level that label 1 has not seen adds nothing.
    """

    def __init__(self, model: LogOdds):
        super().__init__()
        n = len(model.buckets)
        self.base = model.base
        self.row = np.full(BUCKETS, n, np.int32)  # the row behind the last stands for all other buckets: nothing counted
        self.row[model.buckets] = np.arange(n)
        self.clean, self.toxic, self.weight = (np.append(x, np.float32(y)).astype(np.float64) for x, y in ((model.clean, 0), (model.toxic, 0), (model.weight, 1)))

    def learn(self, words: list[bytes]) -> None:
        share = np.full(len(words), self.base)
        for bucket in levels(words):
            at = self.row[bucket]
            share = (self.toxic[at] + self.weight[at] * share) / (self.toxic[at] + self.clean[at] + self.weight[at])
        whole = log(self.base / (1 - self.base))
        self.update(zip(words, (log(x) - whole - STEP for x in (share / (1 - share)).tolist()), strict=True))

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [word for word in words if word not in self]
        if len(self) + len(new) > HELD:
            self.clear()
            new = words
        self.learn(new)
        return np.fromiter(map(self.__getitem__, words), np.float32, len(words))


def _runs(scores: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one sign begin, and their sums; none goes on beyond one of the ``ends``, the last of which ends the scores."""
    up = scores > 0
    new = np.concatenate([[True], up[1:] != up[:-1]])
    new[ends[ends < len(scores)]] = True
    edge = np.flatnonzero(new)
    return edge, np.add.reduceat(scores.astype(np.float64), edge)


def _maximal(sums: list[float], edges: list[int]) -> list[tuple[float, int, int]]:
    """The maximal scoring segments of runs with these sums, that begin and end at these edges."""
    total = 0.0
    # each candidate: sum before it, sum up to its end, first, last + 1, and the nearest earlier one with a smaller left sum
    held: list[list] = []
    for value, (first, last) in zip(sums, pairwise(edges), strict=True):
        before, total = total, total + value
        if value <= 0:
            continue
        left = before
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0 or held[j][1] >= total:
                held.append([left, total, first, last, j])
                break
            left, first = held[j][0], held[j][2]
            del held[j:]
    return [(right - left, first, last) for left, right, first, last, _ in held]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last + 1), by the linear scan of Ruzzo and Tompa.

    Neighbours of one sign are added up first: a maximal segment begins and ends with whole positive runs.
    """
    if not len(scores):
        return []
    edge, sums = _runs(scores, np.array([len(scores)]))
    return _maximal(sums.tolist(), [*edge.tolist(), len(scores)])


@dataclass
class Calibration:
    """Gumbel law of clean documents, and the curve from summed evidence to probability."""

    rate: float
    k: float
    slope: float
    shift: float

    def evidence(self, found: list[float], m: int) -> float:
        """Sum of the significant segments in units of the law; without one, the best segment's (negative) value."""
        base = log(self.k * max(1, m))
        over = [self.rate * s - base for s in found] or [-base]
        sure = sum(x for x in over if x > 0)
        return min(40.0, sure) if sure else max(-15.0, max(over))

    def probability(self, found: list[float], m: int) -> float:
        return 1 / (1 + exp(-max(-500.0, min(500.0, self.slope * self.evidence(found, m) + self.shift))))

    @classmethod
    def fit(cls, rows: list[tuple[int, int, list[float]]]) -> Calibration:
        """``rows``: (label, tokens, scores of all segments)."""
        toxic = sum(r[0] for r in rows)
        if not rows or not 0 < toxic < len(rows):
            share = toxic / len(rows) if rows else 0.0
            return cls(1.0, 1.0, 0.0, log(share / (1 - share)) if 0 < share < 1 else (500.0 if share else -500.0))
        clean = [(max(1, m), max(found, default=0.0)) for label, m, found in rows if not label]
        size, best = np.array(clean, dtype=np.float64).T

        def likelihood(rate: float) -> float:
            return len(best) * (log(rate) - np.log((size * np.exp(-rate * best)).mean())) - rate * best.sum()

        rates = np.geomspace(0.2, 4.0, 120)
        rate = float(rates[int(np.argmax([likelihood(x) for x in rates]))])
        law = cls(rate, float(1 / (size * np.exp(-rate * best)).mean()), 0.0, 0.0)
        x = np.array([law.evidence(found, m) for _, m, found in rows])
        y = np.array([r[0] for r in rows], dtype=np.float64)
        w = np.zeros(2)
        design = np.stack([x, np.ones_like(x)], axis=1)
        for _ in range(60):  # Newton steps with a weak penalty, so that separable classes stay finite
            p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
            penalty = np.array([0.5, 0.01])
            hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
            move = np.linalg.solve(hessian, design.T @ (y - p) - penalty * w)
            w += np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-9:
                break
        return cls(law.rate, law.k, float(w[0]), float(w[1]))


def _again(words: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Those of the places ``up`` whose token stands at another of them at most LOCAL tokens before."""
    order = np.argsort(words[up], kind="stable")
    word, place = words[up][order], up[order]
    return place[1:][(word[1:] == word[:-1]) & (place[1:] - place[:-1] <= LOCAL)]


def _discount(words: np.ndarray, values: np.ndarray) -> None:
    """A token that comes again nearby is no new evidence and costs like any other.

    Nearby: at most LOCAL tokens after its last place, while the sum of scores has not fallen to zero in between (no
    segment spans such a place). So passages are judged by their own tokens, whatever the text mentions before.
    """
    up = np.nonzero(values > 0)[0]
    cost = np.cumsum(np.where(values > 0, 0.0, values))[up].tolist()
    places: dict[int, int] = {}
    total = paid = 0.0
    for at, word, worth, spent in zip(up.tolist(), words[up].tolist(), values[up].tolist(), cost, strict=True):
        total, paid = total + spent - paid, spent
        if total <= 0:
            total = 0.0
            places.clear()
        if at - places.get(word, -LOCAL - 1) <= LOCAL:
            values[at] = worth = -STEP
        total += worth
        places[word] = at


def _scan(texts: list[str], scores: _Scores) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """Tokens and segments of each text."""
    words, at, ends = words_of(texts)
    if not len(at):
        yield from ((0, []) for _ in texts)
        return
    values = scores.of(words)[at]
    starts = np.concatenate([[0], ends[:-1]])
    for i in np.unique(np.searchsorted(ends, _again(at, np.flatnonzero(values > 0)), side="right")).tolist():
        _discount(at[starts[i]: ends[i]], values[starts[i]: ends[i]])
    edge, sums = _runs(values, ends)
    first, last = np.searchsorted(edge, starts), np.searchsorted(edge, ends)
    edge, sums = [*edge.tolist(), len(at)], sums.tolist()
    for a, b, i, j in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
        yield b - a, [(score, x - a, y - a) for score, x, y in _maximal(sums[i:j], edge[i: j + 1])] if a < b else []


def _scans(texts: pa.Array, scores: _Scores) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    for _, piece in _pieces(texts):
        yield from _scan(piece, scores)


def _calibrator(shared: Broadcast) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(LogOdds(*shared.value))
        for batch in batches:
            found = list(_scans(batch.column(0), scores))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([m for m, _ in found], pa.int64()), pa.array([[s for s, _, _ in f] for _, f in found], pa.list_(pa.float64()))], names=["label", "m", "found"])

    return run


_RESULT = "id long, held_out boolean, score double, n_tokens long, passages array<struct<score:double,first:int,last:int>>"
_PASSAGES = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))


def _scorer(shared: Broadcast, law: Calibration) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(LogOdds(*shared.value))
        for batch in batches:
            probability, size, passages = [], [], []
            for m, found in _scans(batch.column(2), scores):
                probability.append(law.probability([s for s, _, _ in found], m))
                base = log(law.k * max(1, m))
                passages.append([(s, a, b - 1) for s, a, b in found if law.rate * s > base])
                size.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(probability, pa.float64()), pa.array(size, pa.int64()), pa.array(passages, _PASSAGES)], names=["id", "held_out", "score", "n_tokens", "passages"])

    return run


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", held_out: int = 2) -> DataFrame:
    """(id, label, fold): the labelled rows to learn from, at most MAX_LABELLED; of several labels of an id the largest."""
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("label_id IS NOT NULL AND label IN (0, 1)").groupBy("label_id").agg(F.max("label").alias("label"))
    known = known.withColumn("fold", fold("label_id").cast("int")).where(F.col("fold") != held_out)
    return stage(known.orderBy(F.xxhash64("label_id"), "label_id").limit(MAX_LABELLED), "labels")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 2) -> tuple[Broadcast, Calibration]:
    """The broadcast log-odds and the calibration. Labels are learnt from, and prior counts taken over all of ``docs``."""
    text_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    train = train_rows(labels, id_col, label_col, held_out)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # at most MAX_LABELLED rows of three numbers are broadcast; the last training fold calibrates, the others count
    last = max(f for f in range(4) if f != held_out)
    second = (F.col("fold") == last).cast("int")
    toxic = slim.join(F.broadcast(train.where("label = 1")), slim["id"] == train["label_id"])
    buckets, toxic = _counted(toxic.select("text", second.alias("part")), 2)
    marked = np.zeros(BUCKETS, bool)
    marked[buckets] = True
    known = sc.broadcast(np.packbits(marked))
    joined = slim.join(F.broadcast(train), slim["id"] == train["label_id"], "left")
    group = F.when(F.col("label") == 0, second).when(F.col("label") == 1, 2).otherwise(3)
    at, counts = _counted(joined.select("text", group.alias("part")), 4, known)
    rest = np.zeros((4, len(buckets)))  # of the buckets that label 1 has, as no other is asked for
    rest[:, np.searchsorted(buckets, at)] = counts
    corpus = rest.sum(axis=0)
    part, whole = LogOdds.fit(buckets, corpus, rest[0], toxic[0]), LogOdds.fit(buckets, corpus, rest[:2].sum(axis=0), toxic.sum(axis=0))
    calibration = train.where(F.col("fold") == last).orderBy(F.xxhash64("label_id"), "label_id").limit(MAX_CALIBRATION)
    seen = slim.join(F.broadcast(calibration), slim["id"] == calibration["label_id"]).select("text", "label")
    rows = seen.mapInArrow(lean(_calibrator(sc.broadcast(astuple(part)))), "label int, m long, found array<double>").collect()
    return sc.broadcast(astuple(whole)), Calibration.fit([(r.label, r.m, list(r.found)) for r in rows])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 2) -> DataFrame:
    """(id, held_out, score, n_tokens, passages) of every row; a passage has its score and first and last token."""
    shared, law = fit(docs, labels, id_col, text_col, label_col, held_out)
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(fold(id_col) == held_out, F.lit(False)).alias("held_out"), text_of(text_col).alias("text"))
    return known.mapInArrow(lean(_scorer(shared, law)), _RESULT)


def _rejecter(shared: Broadcast, law: Calibration, threshold: float, text_at: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(LogOdds(*shared.value))
        for batch in batches:
            keep = [law.probability([s for s, _, _ in found], m) < threshold for m, found in _scans(batch.column(text_at), scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; rows are judged where they are read, nothing is shuffled."""
    shared, law = fit(docs, labels, id_col, text_col)
    return docs.mapInArrow(lean(_rejecter(shared, law, threshold, docs.columns.index(text_col))), docs.schema)
