"""Connected components over long node ids by alternating large-star and small-star steps.

Both steps join the edges with one minimum per node. The minimum is a partial aggregate and the join may be
split by AQE, so a hub that touches a third of the nodes is spread over many tasks. Nothing reaches the driver
but one count and one checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewatch.llm.common import stage

EDGE = "a long, b long"
_EDGE_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])
FOREST_EDGES = 2_000_000


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the pairs (left[i], right[i])."""
    root = np.arange(n, dtype=np.int64)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        left, right, low, high = left[open_], right[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge per node, to the smallest id that the given edges reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(len(nodes), at[: len(a)], at[len(a):])
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_a, held_b = [], []
    held = 0
    for batch in batches:
        held_a.append(batch.column(0).to_numpy())
        held_b.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= FOREST_EDGES:  # fold what is held, so that memory stays bounded
            yield _edge_batch(held_a, held_b)
            held_a, held_b, held = [], [], 0
    if held:
        yield _edge_batch(held_a, held_b)


def _edge_batch(held_a: list[np.ndarray], held_b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_EDGE_ARROW)


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``edges`` (a long, b long), in any order and with repeats -> (node, component), the smallest id reachable.

    Only nodes with an edge to another node come back. Null ends and self-loops are ignored; no edges give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    now = stage(edges.mapInArrow(_forests, EDGE), tag)
    before = None
    while True:
        count, check = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if not count or (count, check) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = (count, check)
        now = stage(_small_star(_large_star(now)), tag)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.selectExpr("b AS a", "a AS b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
