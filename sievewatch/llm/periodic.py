"""Runs of periodic words: stretches that repeat a block of words at least four times, found by a dictionary of basic factors.

Level k of the dictionary names every factor of 2^k words, made from the names of its halves; a factor that occurs once
in its document is dropped, as no longer factor over it occurs twice. Where the next occurrence of a factor comes within
2 * 2^k words and the one after it at the same distance, the three form an arithmetic progression that proposes the distance
as a period. Neighbouring starts with one distance are one proposal; it is extended word by word in both directions,
kept if it is long enough, and runs found at several levels are kept once.

Nothing is lost: take a run of period q and length 4q or more, and the least 2^k >= q. The factor of 2^k words at the run's
start recurs after q words and again after 2q, within the run; an earlier recurrence would give the run a smaller period. The
distance of a progression is also the smallest period of its stretch, for the same reason.

A document is one row and is examined whole in one task, without a shuffle. Documents share a dictionary in blocks of about
BLOCK_WORDS words, so memory is bounded by that or by the longest text.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; texts of any length are examined whole;
repeated rows and rows with a null id each give a row; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewatch.llm.common import lean, text_batches, text_of

#: A run has at least this many words and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words that share a dictionary, unless one document has more.
BLOCK_WORDS = 1 << 19
#: Words compared at first when a stretch is extended; doubled as long as all agree.
STEP = 32

#: Rewrites the words of the row with this id before they are examined.
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
_RUN = "struct<start: long, length: long, period: long>"
_RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def words_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space, which is what bytes.split parts at."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _named(keys: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, name, next place or -1) of the factors that occur twice in a document; ``at`` ascends, ``doc`` is by place."""
    order = np.argsort(keys, kind="stable")
    sorted_keys, sorted_at = keys[order], at[order]
    fresh = sorted_keys[1:] != sorted_keys[:-1]
    twin = ~fresh & (doc[sorted_at[1:]] == doc[sorted_at[:-1]])
    names = np.zeros(len(keys), np.int64)
    np.cumsum(fresh, out=names[1:])
    after = np.full(len(keys), -1, np.int64)
    after[:-1][twin] = sorted_at[1:][twin]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= twin
    twice[:-1] |= twin
    return sorted_at[twice], names[twice], after[twice]


def _agreeing(words: np.ndarray, left: int, right: int, step: int, room: int) -> int:
    """How many words agree from ``left`` and ``right`` on, going by ``step`` (1 or -1), at most ``room``."""
    done, width = 0, STEP
    while done < room:
        width = min(width, room - done)
        if step > 0:
            a, b = words[left + done: left + done + width], words[right + done: right + done + width]
        else:
            a, b = words[left - done - width + 1: left - done + 1][::-1], words[right - done - width + 1: right - done + 1][::-1]
        differ = a != b
        if differ.any():
            return done + int(differ.argmax())
        done += width
        width *= 2
    return done


def _proposals(at: np.ndarray, after: np.ndarray, span: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first start, period) of each stretch of neighbouring starts whose next two occurrences lie at one distance of at most 2 * ``span``."""
    gap = np.zeros(size, np.int32)
    gap[at[after >= 0]] = (after - at)[after >= 0]
    near = at[(after >= 0) & (after - at <= 2 * span)]
    near = np.sort(near[gap[near + gap[near]] == gap[near]])
    period = gap[near].astype(np.int64)
    first = np.ones(len(near), bool)
    first[1:] = (near[1:] != near[:-1] + 1) | (period[1:] != period[:-1])
    return near[first], period[first]


def find_runs(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; ``words`` are numbers, ``ends`` cut them into documents."""
    size = len(words)
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends), dtype=np.int32), sizes)
    longest = int(sizes.max(initial=0)) // LEAST_PERIODS  # the largest period a run can have
    low, high = ends - sizes, ends
    found: set[tuple[int, int, int]] = set()
    reach: dict[int, int] = {}  # period -> end of the last stretch examined, for proposals inside it
    at, names, after = _named(words, np.arange(size), doc) if size else (words, words, words)
    span = 1
    while len(at) and span < 2 * longest:
        reach.clear()
        starts, periods = _proposals(at, after, span, size)
        for start, period in zip(starts.tolist(), periods.tolist(), strict=True):
            if start + 2 * period + span <= reach.get(period, 0):
                continue
            from_, to = int(low[doc[start]]), int(high[doc[start]])
            back = _agreeing(words, start - 1, start - 1 + period, -1, start - from_)
            known = start + span + period  # the words up to here agree with those a period before
            end = known + _agreeing(words, known - period, known, 1, to - known)
            reach[period] = end
            if end - start + back >= max(LEAST_WORDS, LEAST_PERIODS * period):
                found.add((start - back, end - start + back, period))
        # the next level joins two neighbouring factors that both occur twice
        name = np.full(size, -1, np.int64)
        name[at] = names
        at = np.sort(at)
        at = at[at + span < size]
        at = at[(name[at + span] >= 0) & (doc[at + span] == doc[at])]
        keys = name[at] * (int(names.max()) + 1) + name[at + span]
        at, names, after = _named(keys, at, doc) if len(at) else (at, keys, keys)
        span *= 2
    runs = np.array(sorted((s, p, n) for s, n, p in found), np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.nonzero(np.cumsum(edge[:-1]) == 0)[0].tolist()
    return b" ".join([words[i] for i in kept])


def _examiner(rewrite: Rewrite | None) -> Callable:
    def examined(ids: list, held: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
        total = int(ends[-1]) if len(held) else 0
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for doc in held for w in doc), np.int64, total)
        start, length, period = find_runs(words, ends)
        own = np.searchsorted(ends, start, side="right")
        runs: list[list[tuple[int, int, int]]] = [[] for _ in held]
        base = (ends - np.diff(ends, prepend=0))[own]
        for d, *run in zip(own.tolist(), (start - base).tolist(), length.tolist(), period.tolist(), strict=True):
            runs[d].append(tuple(run))
        texts = pa.array([_collapsed(doc, r) for doc, r in zip(held, runs, strict=True)], pa.binary())
        shaped = pa.array([[dict(zip(("start", "length", "period"), run, strict=True)) for run in r] for r in runs], pa.list_(_RUN_ARROW))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, held)), pa.int64()), shaped, texts.cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    def examine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, waiting = [], [], 0
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if rewrite is not None:
                    words = rewrite(id_, words)
                if held and waiting + len(words) > BLOCK_WORDS:
                    yield examined(ids, held)
                    ids, held, waiting = [], [], 0
                ids.append(id_)
                held.append(words)
                waiting += len(words)
            if held:
                yield examined(ids, held)

    return examine


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """(id, n_words, runs by start and period, collapsed text without the repeats) of each row."""
    text_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(lean(_examiner(rewrite)), f"id long, n_words long, runs array<{_RUN}>, collapsed string")


def run_report(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest one (ties: smallest start, then period) and digests."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.select("id", "runs", longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "id", F.size("runs").cast("long").alias("n_runs"), F.expr("-top.start").alias("start"), F.col("top.length").alias("length"), F.expr("-top.period").alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
