"""Nearest neighbours and near-duplicate vectors by one small-world graph per shard.

Equal vectors are collapsed first, so a vector that a third of all rows share is one node. Distinct vectors are hashed to
shards of at most about SHARD_ROWS (LEAST_SHARDS at least); a task builds the graph of one shard, and the graphs are
written as flat neighbour arrays, a row per node. Every shard is asked for every query: a task takes one shard and one
block of queries. It audits a sample of its queries against brute force over the shard and widens the beam until recall
reaches TARGET (for near-duplicates: the mean recall of queries with few links and with many, each on its own); a beam as wide as the shard is a full scan. Results of shards are merged. Vectors of different length
never meet. Products that are returned or tested are taken in double precision on the original vectors.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; null ids pass
as rows of their own; equal vectors and repeated rows are neighbours of each other; an empty table gives no rows;
further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewatch.llm import hnsw
from sievewatch.llm.common import stage
from sievewatch.llm.components import connected_components, forest

SHARD_ROWS = 500_000
LEAST_SHARDS = 6
#: Queries in a block, and every how many of them one is audited.
BLOCK_ROWS = 1 << 16
AUDIT_EVERY = 32
TARGET = 0.98
#: Nodes of a shard that get a made-up link for the audit, so that even shards with few links are audited.
PROBES = 512
BEAM = 64
#: A query with so many links in a shard counts them by its own search; the pairs of others are written, and count for both ends.
PAIRS = 64
#: Products held at a time by a full scan.
SCAN = 1 << 23

_INDEX = "dim int, shard int, node int, gid long, copies long, vector array<double>, links array<array<int>>"


def usable(column: str) -> Column:
    v = F.col(column)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(gid, dim, vector, copies) of each distinct usable vector; ``gid`` is its smallest id."""
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable("vector"))
    grouped = vectors.groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    return grouped.select(F.coalesce("first", F.xxhash64("vector")).alias("gid"), F.size("vector").alias("dim"), "vector", "copies")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _builder(cosine: bool) -> Callable:
    def run(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in key)
        got = got.sort_by("gid")  # the same graph whatever order the rows come in
        vectors = _matrix(got.column("vector"), dim)
        graph = hnsw.build(_unit(vectors) if cosine else vectors, seed=shard)
        links = [[layer[node].tolist() for layer in graph.layers if node < len(layer)] for node in range(len(vectors))]
        n = len(vectors)
        return pa.table({
            "dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "node": pa.array(range(n), pa.int32()),
            "gid": got.column("gid"), "copies": got.column("copies"), "vector": got.column("vector"), "links": pa.array(links, pa.list_(pa.list_(pa.int32()))),
        })

    return run


def build_index(vectors: DataFrame, cosine: bool, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """``vectors`` (gid, dim, vector, copies) -> the written index, one row per node, and the number of shards."""
    shards = max(LEAST_SHARDS, ceil(vectors.count() / shard_rows))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("gid", F.lit(5)), F.lit(shards)).cast("int"))
    placed = placed.repartitionByRange(shards, "dim", "shard")
    return stage(placed.groupBy("dim", "shard").applyInArrow(_builder(cosine), _INDEX), "hnsw"), shards


def _load(index: pa.Table, dim: int, cosine: bool) -> tuple[hnsw.Graph, np.ndarray, np.ndarray, np.ndarray]:
    index = index.sort_by("node")
    vectors = _matrix(index.column("vector"), dim)
    links = index.column("links").combine_chunks()
    height = np.diff(links.offsets.to_numpy())  # layers of each node
    flat = links.flatten()
    starts, widths, ends = flat.offsets.to_numpy()[:-1], np.diff(flat.offsets.to_numpy()), flat.flatten().to_numpy()
    starts = starts - flat.offsets.to_numpy()[0]
    first = np.cumsum(height) - height
    layers = []
    for k in range(int(height.max())):
        rows = first[: int((height > k).sum())] + k
        layers.append(ends[starts[rows][:, None] + np.arange(widths[rows[0]])])
    unit = _unit(vectors) if cosine else vectors
    return hnsw.Graph(unit.astype(np.float32), layers), vectors, index.column("gid").to_numpy(), index.column("copies").to_numpy()


def _sample(n: int) -> np.ndarray:
    return np.arange(0, n, AUDIT_EVERY)


def _asker(index: DataFrame, queries: DataFrame, shards: int, run: Callable, schema: str) -> DataFrame:
    """Every shard meets every block of ``queries`` (qid, dim, vector) in a task of its own."""
    blocks = max(1, ceil(queries.count() / BLOCK_ROWS))
    block = F.pmod(F.xxhash64("qid", F.lit(9)), F.lit(blocks)).cast("int")
    asked = queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "shard", "block"]
    return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, schema)


def _nearest(k: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], index: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "gid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not index.num_rows or not queries.num_rows:
            return empty
        dim = key[0].as_py()
        graph, vectors, gids, _ = _load(index, dim, False)
        asked, qids = _matrix(queries.column("vector"), dim), queries.column("qid").to_numpy()
        most = min(k, len(vectors))
        some = _sample(len(asked))
        exact = _scan_top(vectors, asked[some], most)
        beam = max(BEAM, 2 * k)
        while True:
            wide = beam >= len(vectors)
            found = None if wide else hnsw.search(graph, asked[some], beam)[0]
            if wide or _recall(_scores(vectors, asked[some], found), exact) >= TARGET:
                break
            beam += beam // 2
        out_q, out_g, out_s = [], [], []
        step = max(1, min(hnsw.ROWS, SCAN // len(vectors))) if wide else hnsw.ROWS
        for at in range(0, len(asked), step):
            part = asked[at: at + step]
            found = np.tile(np.arange(len(vectors), dtype=np.int32), (len(part), 1)) if wide else hnsw.search(graph, part, beam)[0]
            scores = _scores(vectors, part, found, ordered=False)
            order = np.lexsort((np.where(found >= 0, gids[found], 0), -scores), axis=1)[:, :most]
            scores, found = np.take_along_axis(scores, order, axis=1), np.take_along_axis(found, order, axis=1)
            row, col = np.nonzero(np.isfinite(scores))
            out_q.append(qids[at + row])
            out_g.append(gids[found[row, col]])
            out_s.append(scores[row, col])
        return pa.table({"qid": np.concatenate(out_q), "gid": np.concatenate(out_g), "score": np.concatenate(out_s)})

    return run


def _scores(vectors: np.ndarray, queries: np.ndarray, found: np.ndarray, ordered: bool = True) -> np.ndarray:
    """Products of each query with its nodes in double precision, one by one so that order and batch do not matter."""
    out = np.empty(found.shape)
    step = max(1, SCAN // (found.shape[1] * vectors.shape[1]))
    for at in range(0, len(queries), step):
        part = found[at: at + step]
        out[at: at + step] = np.where(part >= 0, (vectors[part] * queries[at: at + step, None, :]).sum(axis=2), -np.inf)
    return -np.sort(-out, axis=1) if ordered else out


def _recall(scores: np.ndarray, exact: np.ndarray) -> float:
    """The share of the nearest (``exact``: their products) that is among ``scores``, largest first; by value, so that ties do not
    count as misses, and against the least of ``exact``, so that one miss does not count for all behind it."""
    return (scores[:, : exact.shape[1]] >= exact[:, -1:] - 1e-9).mean()


def _scan_top(vectors: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The k largest products of each query, by brute force in blocks."""
    out = np.empty((len(queries), k))
    step = max(1, SCAN // len(vectors))
    for at in range(0, len(queries), step):
        out[at: at + step] = -np.sort(np.partition(-(queries[at: at + step] @ vectors.T), k - 1, axis=1)[:, :k], axis=1)
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows with the largest inner product for each of ``queries``, the query's own
    row (same id) left out; ties go to the smaller id.

    A row that is repeated counts once, as a query and as a neighbour. An id with several vectors is near with the best of
    them, on either side, and is a neighbour once.
    """
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable("vector"))
    vectors = stage(distinct_vectors(rows, id_col, vector_col), "distinct-vectors")
    index, shards = build_index(vectors, cosine=False)
    asked = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable("vector"))
    asked = stage(asked.distinct().withColumn("dim", F.size("vector")), "queries")
    found = _asker(index, asked, shards, _nearest(k + 1), "qid long, gid long, score double")  # one more for the query itself
    # of equal vectors, no more than the k + 1 smallest ids can be among the nearest
    copy = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last()))
    copies = held.distinct().withColumn("copy", copy).where(F.col("copy") <= k + 1)
    copies = copies.join(stage(vectors.select("gid", "vector"), "groups"), "vector").select("gid", "id")
    merged = found.join(stage(copies, "copies"), "gid").where(~F.col("id").eqNullSafe(F.col("qid"))).groupBy("qid", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", "id", "score")


def _near_pairs(threshold: float) -> Callable:
    """Per query of many links, or one that was scanned: copies of the rows it links to (kind 0). A spanning forest of all
    links (kind 1). The links of other queries, one by one (kind 2)."""

    def run(key: tuple[pa.Scalar, ...], index: pa.Table, queries: pa.Table) -> pa.Table:
        empty = np.empty(0, np.int64)
        if not index.num_rows or not queries.num_rows:
            return pa.table({"kind": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "a": empty, "b": empty})
        dim, shard = key[0].as_py(), key[1].as_py()
        graph, vectors, gids, copies = _load(index, dim, True)
        asked, qids = _matrix(queries.column("vector"), dim), queries.column("qid").to_numpy()
        unit, asked_unit = _unit(vectors), _unit(asked)
        audit = _audit(unit, gids, asked_unit, qids, threshold)
        beam = BEAM
        while beam < len(vectors) and not _passes(graph, unit, audit, beam, threshold):
            beam *= 2
        count, counted = np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        edges, pairs = [empty, empty], [empty, empty]
        for row, node in _links(graph, unit, asked_unit, beam, threshold, counted):
            other = gids[node] != qids[row]
            row, node = row[other], node[other]
            np.add.at(count, row, copies[node])
            counted |= np.bincount(row, minlength=len(asked)) > PAIRS  # all links of a query come at once
            few = ~counted[row]
            pairs = [np.concatenate([p, x]) for p, x in zip(pairs, (qids[row[few]], gids[node[few]]), strict=True)]
            edges = [np.concatenate([e, x]) for e, x in zip(edges, (qids[row], gids[node]), strict=True)]
            if len(edges[0]) > 1 << 21:
                edges = list(forest(*edges))
        edges = forest(*edges)
        some = np.nonzero(counted)[0]
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(some), len(edges[0]), len(pairs[0])])
        return pa.table({
            "kind": kind, "shard": np.full(len(kind), shard, np.int32),
            "a": np.concatenate([qids[some], edges[0], pairs[0]]), "b": np.concatenate([count[some], edges[1], pairs[1]]),
        })

    return run


def _audit(unit: np.ndarray, gids: np.ndarray, asked: np.ndarray, qids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Audited queries, their own nodes (-1: not in this shard) and how many other nodes they link to, by brute force.

    Links may be rare and lie in other shards, so probes join the sampled queries: vectors with a cosine between
    ``threshold`` and 1 to a node, in a random direction, for nodes spread over the shard.
    """
    some = _sample(len(asked))
    order = np.argsort(gids)
    place = order[np.minimum(np.searchsorted(gids[order], qids[some]), len(gids) - 1)]
    own = np.where(gids[place] == qids[some], place, -1)
    drawn = np.random.default_rng(len(gids))
    nodes = unit[drawn.choice(len(unit), min(PROBES, len(unit)), replace=False)]
    aside = drawn.normal(size=nodes.shape)
    aside -= (aside * nodes).sum(axis=1, keepdims=True) * nodes
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-9)  # one dimension has no aside
    cosine = drawn.uniform(min(threshold, 1.0), 1.0, (len(nodes), 1))
    probes = cosine * nodes + np.sqrt(1 - cosine**2) * aside
    queries, own = np.concatenate([asked[some], probes]), np.concatenate([own, np.full(len(probes), -1)])
    truth = np.empty(len(queries), np.int64)
    for at in range(0, len(queries), 64):
        truth[at: at + 64] = (queries[at: at + 64] @ unit.T >= threshold).sum(axis=1)
    truth -= own >= 0
    linked = truth > 0
    return queries[linked], own[linked], truth[linked]


def _passes(graph: hnsw.Graph, unit: np.ndarray, audit: tuple[np.ndarray, np.ndarray, np.ndarray], beam: int, threshold: float) -> bool:
    """Whether the mean recall of queries reaches TARGET among those with 1, 2 to 3, 4 to 7, ... links alike."""
    queries, own, truth = audit
    got = np.zeros(len(queries), np.int64)
    for row, node in _links(graph, unit, queries, beam, threshold):
        np.add.at(got, row[node != own[row]], 1)
    recall, group = np.minimum(1.0, got / truth), np.log2(truth).astype(int)
    return all(recall[group == g].mean() >= TARGET for g in np.unique(group))


def _links(graph: hnsw.Graph, unit: np.ndarray, asked: np.ndarray, beam: int, threshold: float, scanned: np.ndarray | None = None):
    """(query row, node) with a cosine of ``threshold`` or more, a beam full of such nodes being widened until it is not;
    all nodes of a row come in one piece. Rows that were compared with the whole shard are marked in ``scanned``."""
    todo = np.arange(len(asked))
    while len(todo):
        again = []
        for at in range(0, len(todo), hnsw.ROWS):
            rows = todo[at: at + hnsw.ROWS]
            if beam * 4 >= len(unit):  # wide beams cost more than all products
                step = max(1, SCAN // len(unit))
                if scanned is not None:
                    scanned[rows] = True
                for a in range(0, len(rows), step):
                    r, node = np.nonzero(asked[rows[a: a + step]].astype(np.float32) @ graph.vectors.T >= threshold - 1e-5)
                    yield _sure(unit, asked, rows[a: a + step][r], node, threshold)
                continue
            found, near = hnsw.search(graph, asked[rows], beam)
            full = near[:, -1] >= threshold - 1e-5
            again.append(rows[full])
            r, c = np.nonzero((near >= threshold - 1e-5) & ~full[:, None])
            yield _sure(unit, asked, rows[r], found[r, c], threshold)
        todo = np.concatenate(again) if again else np.empty(0, np.int64)
        beam *= 4


def _sure(unit: np.ndarray, asked: np.ndarray, row: np.ndarray, node: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    keep = np.zeros(len(row), bool)
    for at in range(0, len(row), 1 << 16):
        keep[at: at + (1 << 16)] = (asked[row[at: at + (1 << 16)]] * unit[node[at: at + (1 << 16)]]).sum(axis=1) >= threshold
    return row[keep], node[keep]


def near_duplicates(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    A link that a search found from one end counts for both, but that an end with over PAIRS links in the other's shard counts
    what its own search found there.
    """
    vectors = stage(distinct_vectors(rows, id_col, vector_col), "distinct-vectors")
    index, shards = build_index(vectors, cosine=True)
    asked = vectors.select(F.col("gid").alias("qid"), "dim", "vector")
    found = stage(_asker(index, asked, shards, _near_pairs(threshold), "kind int, shard int, a long, b long"), "links")
    joined = stage(connected_components(found.where("kind = 1").select("a", "b"), "vector-components").withColumnRenamed("node", "gid"), "members")
    # pairs of both ends once, but for ends that counted the other's shard themselves
    counted = found.where("kind = 0").select(F.col("a").alias("gid"), "shard", "b")
    pairs = found.where("kind = 2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = stage(pairs.unionAll(pairs.select("b", "a")), "link-ends").join(index.select(F.col("gid").alias("b"), "shard", "copies"), "b")
    ends = ends.select(F.col("a").alias("gid"), "shard", F.col("copies").alias("b")).join(counted, ["gid", "shard"], "left_anti")
    counts = stage(counted.unionAll(ends).groupBy("gid").agg(F.sum("b").alias("others")), "link-counts")
    groups = vectors.join(counts, "gid", "left").join(joined, "gid", "left")
    groups = stage(groups.select("vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "gid").alias("component_id")), "classes")
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("own"))
    own = own.withColumn("vector", F.when(usable("own"), F.col("own"))).drop("own")
    links = own.join(groups, "vector", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return links.withColumn("kept", F.col("id") == F.col("component_id"))
