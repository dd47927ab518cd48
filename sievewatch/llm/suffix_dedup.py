"""Removal of repeated passages: every byte covered by a ``least``-byte string that also starts anywhere else goes.

How the work is dealt out: each start of a ``least``-byte string is assigned to one anchor, the smallest hash among the
``GRAM``-byte grams inside the string (winnowing). The choice depends on the string alone, so all places of a repeated
string get the same anchor and meet, and each start is tested exactly once. Anchors are counted by a partial aggregate;
those seen once end there. Stretches that are equal as a whole collapse to one row with a count (all their starts
repeat). The distinct stretches that share an anchor go through the interval expansion of ``bwt.py``, many anchors at
a time; an anchor with very many distinct stretches is split into blocks and every pair of blocks is examined, which
is exact and keeps each task's share bounded.

Hashes of 64 bits decide only within rows of an equal 64-bit anchor.

Defined cases: a null text counts as empty; texts shorter than ``least`` bytes keep all their bytes; a repeated row
counts as another document, so a long one loses all its bytes in each copy; rows with a null id are handled like
others; overlaps within one document count; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewatch.llm.bwt import repeated_starts
from sievewatch.llm.common import Scratch, lean, stage, text_batches, text_of

LEAST = 400
GRAM = 160
#: Bytes of text hashed at a time, unless one document is longer.
BUFFER = 2 << 20
#: Bytes of stretches that go through one transform, and the most distinct stretches of an anchor in one block.
TRANSFORM = 1 << 20
BLOCK_ROWS = 512

_OCCURRENCES = "id long, text_hash long, anchor long, stretch long, start int, n int"
_STRETCHES = "id long, text_hash long, anchor long, block long, start int, n int, bytes binary"
_SPANS = "id long, text_hash long, s int, e int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
    return np.cumprod(up), np.cumprod(down), values


def gram_hashes(data: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes that start at each position."""
    up, down, values = tables
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=total[1:])
    hashed = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    hashed ^= hashed >> np.uint64(31)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(29)
    return hashed


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def anchors(data: np.ndarray, ends: np.ndarray, tables: tuple, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Stretches of starts with one anchor: (document, first start, last start, anchor); ``ends`` cuts data into documents."""
    empty = np.empty(0, np.int64)
    if len(data) < least:
        return empty, empty, empty, empty
    hashed = gram_hashes(data, tables, gram)
    places = np.arange(len(hashed), dtype=np.uint64)
    chosen = sliding_least((hashed >> np.uint64(32) << np.uint64(32)) | places, least - gram + 1) & np.uint64(0xFFFFFFFF)
    chosen = chosen.astype(np.int64)  # of each start, the leftmost gram with the least upper half
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    room = np.maximum(sizes - least + 1, 0)  # starts of each document
    doc = np.repeat(np.arange(len(ends)), room)
    at = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + starts[doc]
    if not len(at):
        return empty, empty, empty, empty
    chosen = chosen[at]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return doc[first], at[first] - starts[doc[first]], at[last] - starts[doc[first]], hashed[chosen[first]].view(np.int64)


def _bytes_of(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _finder(least: int) -> Callable:
    gram = max(1, least * 2 // 5)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _powers(BUFFER)
        for batch in batches:
            texts = [_bytes_of(v) for v in batch.column(2)]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + sizes[to] <= BUFFER):
                    held += sizes[to]
                    to += 1
                if held > len(tables[0]) - 1:
                    tables = _powers(int(held))
                whole = b"".join(texts[at:to])
                doc, first, last, anchor = anchors(np.frombuffer(whole, np.uint8), np.cumsum(sizes[at:to]), tables, least, gram)
                offset = (np.cumsum(sizes[at:to]) - sizes[at:to])[doc]
                digest = xxhash.xxh3_64_intdigest
                stretch = np.fromiter((digest(whole[a:b]) for a, b in zip((offset + first).tolist(), (offset + last + least).tolist(), strict=True)), np.uint64, len(doc))
                rows = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor), pa.array(stretch.view(np.int64)), pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
                    names=["id", "text_hash", "anchor", "stretch", "start", "n"],
                )
                at = to

    return find


def _cutter(least: int) -> Callable:
    """Rows (id, text_hash, text, wanted) -> the bytes of each wanted stretch."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            lists = wanted.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            start, n = lists.field("start").to_numpy(), lists.field("n").to_numpy()
            texts = [_bytes_of(v) for v in batch.column(2)]
            parts = [texts[r][s: s + k + least - 1] for r, s, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), lists.field("anchor"), lists.field("block"), lists.field("start"), lists.field("n"), pa.array(parts, pa.binary())],
                names=["id", "text_hash", "anchor", "block", "start", "n", "bytes"],
            )

    return cut


def _expander(least: int) -> Callable:
    """Rows sorted by (anchor, block) -> spans of the starts that repeat; whole groups share a transform."""

    def spans(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.fromiter((len(r[4]) + 1 for r in held), np.int64, len(held))
        starts = np.cumsum(sizes) - sizes
        symbols = np.zeros(int(sizes.sum()), np.uint16)
        joined = np.frombuffer(b"\0".join(r[4] for r in held) + b"\0", np.uint8)
        symbols[:] = joined
        symbols += 1
        symbols[starts + sizes - 1] = 0
        found = repeated_starts(symbols, least)
        edge = np.diff(found.astype(np.int8), prepend=0)
        low, high = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        row = np.searchsorted(starts, low, side="right") - 1
        base = np.fromiter((r[2] for r in held), np.int64, len(held))[row] - starts[row]
        rows = row.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([held[r][0] for r in rows], pa.int64()), pa.array([held[r][1] for r in rows], pa.int64()), pa.array((low + base).astype(np.int32)), pa.array((high + base + least - 1).astype(np.int32))],
            names=["id", "text_hash", "s", "e"],
        )

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("id", "text_hash", "start", "n", "bytes", "anchor", "block")}
            for row in zip(*columns.values(), strict=True):
                if row[5:] != group:
                    # blocks of one anchor share stretches, which must not count as repeats of themselves
                    if size >= TRANSFORM or held and group[0] == row[5]:
                        yield spans(held)
                        held, size = [], 0
                    group = row[5:]
                held.append(row[:5])
                size += len(row[4])
        if held:
            yield spans(held)

    return expand


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows are told apart by id and text hash; rows equal in both have equal spans."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def _same_row(left: str, right: str) -> Column:
    return F.expr(f"{left}.id <=> {right}.id AND {left}.text_hash = {right}.text_hash")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, text_hash, s, e): byte ranges to remove, with overlaps."""
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "repeats")
    slim = _slim(docs, id_col, text_col)
    # written once: counting and joining would each hash every gram again
    found = scratch.stage(slim.where(F.length("text") >= least).mapInArrow(lean(_finder(least)), _OCCURRENCES), "occurrences")
    # joined tables are written first: AQE splits a hot key only where both sides come straight from a shuffle
    counts = scratch.stage(found.groupBy("anchor").agg(F.count("*").alias("seen")).where("seen > 1").select("anchor"), "repeated-anchors")
    shared = scratch.stage(found.join(counts, "anchor"), "shared-anchors")
    distinct = shared.groupBy("anchor", "stretch").agg(F.count("*").alias("copies"), F.min(F.struct("id", "text_hash", "start", "n")).alias("one"))
    distinct = scratch.stage(distinct, "stretches")
    copied = distinct.where("copies > 1").select("anchor", "stretch")
    whole = shared.join(copied, ["anchor", "stretch"]).select("id", "text_hash", F.col("start").alias("s"), F.expr(f"start + n + {least - 1}").alias("e"))
    varied = scratch.stage(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "varied-anchors")
    blocks = F.ceil(F.col("kinds") / BLOCK_ROWS)
    wanted = (
        distinct.join(varied, "anchor")
        .withColumn("blocks", blocks)
        .withColumn("own", F.expr("pmod(xxhash64(stretch), blocks)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("one.*", "anchor", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("block"))
        .groupBy("id", "text_hash")
        .agg(F.collect_list(F.struct("anchor", "block", "start", "n")).alias("wanted"))
    )
    texts = slim.alias("d").join(wanted.alias("w"), _same_row("d", "w")).select("w.id", "w.text_hash", "d.text", "w.wanted")
    texts = texts.mapInArrow(lean(_cutter(least)), _STRETCHES)
    expanded = texts.repartition("anchor", "block").sortWithinPartitions("anchor", "block").mapInArrow(lean(_expander(least)), _SPANS)
    spans = stage(whole.unionAll(expanded), "spans")
    scratch.drop()
    return spans


def merged_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut_out(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes left, and the number of maximal removed runs."""
    runs, left, at = merged_ranges(ranges), [], 0
    for s, e in runs:
        left.append(text[at:s])
        at = e
    left.append(text[at:])
    return b"".join(left), len(runs)


def _with_spans(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Every row of ``docs`` with its columns as ``row``, its bytes as ``text`` and its ``spans`` (null: none)."""
    spans = repeated_spans(docs, id_col, text_col, least)
    spans = spans.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))
    text = text_of(text_col)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row"),
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"), F.col(text_col).isNull().alias("no_text"),
    )
    return rows.alias("d").join(spans.alias("s"), _same_row("d", "s"), "left").select("d.row", "d.id", "d.text", "d.no_text", "s.spans")


def _ranges(value: pa.Scalar) -> list[tuple[int, int]]:
    return [(r["s"], r["e"]) for r in value.as_py()] if value.is_valid else []


def _report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            text = _bytes_of(text)
            left, runs = _cut_out(text, _ranges(spans))
            rows.append((len(text), len(text) - len(left), runs, hashlib.sha256(left).hexdigest()))
        size, gone, runs, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    rows = _with_spans(docs, id_col, text_col, least).select("id", "text", "spans")
    return rows.mapInArrow(lean(_report), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            None if no_text else (_cut_out(_bytes_of(text), _ranges(spans))[0]).decode("utf-8", "ignore")
            for text, spans, no_text in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; bytes of a character that was cut in two go as well."""
    rows = _with_spans(docs, id_col, text_col, least).select("row", "text", "spans", "no_text")
    done = rows.mapInArrow(lean(_rewrite), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return done.select(*((F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
