"""SimHash near-duplicates, joined by walking pairs of nodes of a binary trie.

Fingerprints are computed once per document (Arrow batches), collapsed to distinct values, and laid out as a binary
trie whose most balanced bits come first. The top levels of the trie are dealt out: a subtree goes to every task that
pairs it with a subtree at most ``budget`` bits away. A task walks two subtrees together, adds up differing bits and
drops a pair of nodes as soon as the sum exceeds the budget. Each task returns a spanning forest of the links it
found, so a dense ball of fingerprints never becomes all its pairs.

Defined cases: null and empty texts have no words and get fingerprint zero, linked like any other; equal rows share a
class; rows with a null id get a fingerprint and the class's smallest id, null if it has none; an empty table gives
no rows; further columns are not looked at. Links and components are exact, with no cap on partners.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewatch.llm.common import lean, stage, text_batches, text_of
from sievewatch.llm.components import connected_components, forest

SEED = 42
SHINGLE = 3
BUDGET = 3
BITS = 64
#: Shingles whose bits are unpacked at a time.
BLOCK = 1 << 17
#: A subtree dealt to a task aims at no more fingerprints than this; the least depth keeps small inputs parallel.
SUBTREE = 1 << 16
LEAST_DEPTH = 5
#: Node pairs expanded at a time, and the size product under which two nodes are compared directly.
FRONTIER = 1 << 17
LEAF = 48


def _words(text: str) -> list[bytes]:
    # bytes.lower and bytes.split know ASCII only: A-Z and the six white-space bytes
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = _words(text)
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed=SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    return [digest(joined[a:b]) for a, b in zip(starts, (ends[size - 1:] - 1).tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes give zero."""
    counts, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, BLOCK):
        block = np.array(hashes[at: at + BLOCK], dtype=">u8")
        counts += np.unpackbits(block.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(shingle_hashes(t)) for t in map(str, batch.column(batch.num_columns - 1))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp) of each row; ``text_hash`` tells rows with the same id apart."""
    text_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    slim = slim.select("id", F.xxhash64("text").alias("text_hash"), "text")
    return slim.mapInArrow(lean(_fingerprints), "id long, text_hash long, fp long")


def bit_order(fps: DataFrame) -> list[int]:
    """Bits of the fingerprint (0: highest), the most balanced over all distinct values first: 64 sums, whatever the size."""
    sums = fps.agg(F.count("*"), *(F.sum(F.shiftrightunsigned("fp", 63 - i).bitwiseAND(1)) for i in range(BITS))).first()
    n = max(1, sums[0])
    return sorted(range(BITS), key=lambda i: (abs((sums[i + 1] or 0) / n - 0.5), i))


def reorder(values: np.ndarray, order: list[int]) -> np.ndarray:
    """Move bit order[j] to place j (0: highest)."""
    out = np.zeros_like(values)
    for j, i in enumerate(order):
        out |= ((values >> np.uint64(63 - i)) & np.uint64(1)) << np.uint64(63 - j)
    return out


def restore(values: np.ndarray, order: list[int]) -> np.ndarray:
    back = [0] * BITS
    for j, i in enumerate(order):
        back[i] = j
    return reorder(values, back)


def _dealer(order: list[int], depth: int, budget: int):
    """Pack each subtree's fingerprints into one value per partner subtree: (pair, side, packed)."""
    masks = [sum(1 << b for b in c) for r in range(min(budget, depth) + 1) for c in combinations(range(depth), r)]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            trie = np.sort(reorder(batch.column(0).to_numpy().view(np.uint64), order))
            top = (trie >> np.uint64(BITS - depth)).astype(np.int64)
            cuts = np.searchsorted(top, np.arange((1 << depth) + 1))
            pairs, sides, packed = [], [], []
            for p in range(1 << depth):
                if cuts[p] < cuts[p + 1]:
                    block = trie[cuts[p]: cuts[p + 1]].tobytes()
                    for mask in masks:
                        q = p ^ mask
                        pairs.append(min(p, q) << depth | max(p, q))
                        sides.append(int(p > q))
                        packed.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(sides, pa.int32()), pa.array(packed, pa.binary())], names=["pair", "side", "packed"])

    return deal


def trie_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, spent: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of values at most ``budget`` bits apart in two sorted subtrees; ``right`` None: within ``left``.

    The stack holds blocks of node pairs (range in left, range in right, bits spent). A block is expanded by one bit at
    a time, so memory stays bounded whatever the subtrees hold.
    """
    same = right is None
    right = left if same else right
    if not len(left) or not len(right):
        return
    one = np.array([[0, len(left), 0, len(right), spent]], dtype=np.int64)
    stack = [(depth, one)]
    while stack:
        level, block = stack.pop()
        size = (block[:, 1] - block[:, 0]) * (block[:, 3] - block[:, 2])
        ready = (size <= LEAF) | (level >= BITS)
        if ready.any():
            yield from _leaves(left, right, block[ready], same, budget)
            block = block[~ready]
        if not len(block):
            continue
        bit = np.uint64(BITS - 1 - level)
        mid_l = _middle(left, block[:, 0], block[:, 1], bit)
        mid_r = _middle(right, block[:, 2], block[:, 3], bit)
        kids = []
        for a in (0, 1):
            for b in (0, 1):
                kid = np.stack([mid_l if a else block[:, 0], block[:, 1] if a else mid_l, mid_r if b else block[:, 2], block[:, 3] if b else mid_r, block[:, 4] + (a != b)], axis=1)
                live = (kid[:, 0] < kid[:, 1]) & (kid[:, 2] < kid[:, 3]) & (kid[:, 4] <= budget)
                if same:  # each unordered pair of nodes once
                    live &= kid[:, 0] <= kid[:, 2]
                kids.append(kid[live])
        block = np.concatenate(kids)
        stack.extend((level + 1, block[at: at + FRONTIER]) for at in range(0, len(block), FRONTIER))


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First position in [low, high) whose value has the bit set; all share the bits above it."""
    first = values[low] >> bit << bit
    return np.clip(np.searchsorted(values, first | (np.uint64(1) << bit)), low, high)


def _leaves(left: np.ndarray, right: np.ndarray, block: np.ndarray, same: bool, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (block[:, 1] - block[:, 0]) * (block[:, 3] - block[:, 2])
    at = 0
    ends = np.cumsum(sizes)
    while at < len(block):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + 4 * FRONTIER)))
        part, n = block[at:to], sizes[at:to]
        own = np.repeat(np.arange(len(part)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (part[:, 3] - part[:, 2])[own]
        i, j = part[own, 0] + k // width, part[own, 2] + k % width
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]
        at = to


def _walker(order: list[int], depth: int, budget: int):
    def walk(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        pair = key[0].as_py()
        low, high = pair >> depth, pair & ((1 << depth) - 1)
        sides = got.column("side").to_numpy()
        packed = got.column("packed").to_pylist()
        held = [np.sort(np.frombuffer(b"".join(p for p, s in zip(packed, sides, strict=True) if s == side), np.uint64)) for side in (0, 1)]
        left, right = held[0], None if low == high else held[1]
        values = left if right is None else np.concatenate([left, right])
        shift = 0 if right is None else len(left)
        out_a, out_b = np.empty(0, np.uint64), np.empty(0, np.uint64)
        wait, waiting = [], 0
        for i, j in trie_pairs(left, right, depth, (low ^ high).bit_count(), budget):
            wait.append((values[i], values[j + shift]))
            waiting += len(i)
            if waiting >= 1 << 20:
                out_a, out_b = forest(*(np.concatenate([o, *(w[s] for w in wait)]) for s, o in ((0, out_a), (1, out_b))))
                wait, waiting = [], 0
        out_a, out_b = forest(*(np.concatenate([o, *(w[s] for w in wait)]) for s, o in ((0, out_a), (1, out_b))))
        return pa.table({"a": restore(out_a, order).view(np.int64), "b": restore(out_b, order).view(np.int64)})

    return walk


def trie_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Distinct fingerprints (fp long) -> edges (a, b) that connect exactly what links of ``budget`` bits connect."""
    n = fps.count()
    depth = max(LEAST_DEPTH, ceil(log2(max(1, n) / SUBTREE)))
    order = bit_order(fps)
    dealt = fps.select("fp").mapInArrow(_dealer(order, depth, budget), "pair long, side int, packed binary")
    return dealt.groupBy("pair").applyInArrow(_walker(order, depth, budget), "a long, b long")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(id, text_hash, fp, class) for each row: ``class`` is a long that is equal for rows linked directly or through others."""
    rows = stage(with_fingerprints(docs, id_col, text_col), "fingerprints")
    fps = stage(rows.select("fp").distinct(), "distinct-fingerprints")
    joined = connected_components(trie_links(fps, budget), "fingerprint-components")
    return rows.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("id", "text_hash", "fp", F.coalesce("component", "fp").alias("class"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable)."""
    classes = stage(simhash_classes(docs, id_col, text_col, budget), "classes")
    least = stage(classes.groupBy("class").agg(F.min("id").alias("component_id")), "class-ids")
    return classes.join(least, "class").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` with one left of each class: the smallest id (null last), then the smallest text hash."""
    return keep_first(docs, simhash_classes(docs, id_col, text_col, budget), id_col, text_col)


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each class of ``classes`` (id, text_hash, class)."""
    classes = stage(classes, "classes")
    first = classes.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first"))
    first = first.select(F.col("first.id").alias("_keep_id"), F.col("first.text_hash").alias("_keep_hash")).distinct()
    first = stage(first, "kept")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    hashed = docs.select(row, F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_of(text_col)).alias("_hash"))
    kept = hashed.join(first, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_hash") == F.col("_keep_hash")))
    copy = F.row_number().over(Window.partitionBy("_hash", "_id").orderBy(F.lit(1)))
    return kept.withColumn("_copy", copy).where("_copy = 1").select("row.*")
