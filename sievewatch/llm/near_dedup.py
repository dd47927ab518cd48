"""The pipeline's near-duplicate stage: documents whose sets of five-word shingles have a Jaccard similarity of 0.8.

1. Rows with the same set of shingles are one node. The SimHash fingerprints of the nodes' shingles are joined by the binary
   trie of ``simhash``: fingerprints at most BUDGET bits apart are candidates, and those whose exact similarity suffices are
   links. They give the first components. A walk that finds every pair of similarity 0.8 would need up to 18 of the 64 bits
   and compare nearly all pairs, so what it leaves open is looked for by other candidates:
2. A node gets MinHash values, dealt into BANDS bands of ROWS values; two nodes are candidates if they agree in a band, which a
   pair of similarity s fails with (1 - s^5)^32: 3e-6 at 0.8.
3. In every band value, each node is compared with one leader of another component, the node whose bands are the most common: the
   text that others were made from, rather than one of its copies. Links are kept by exact similarity, and give components.
4. Nodes in band values that still hold several components are joined by an exact prefix filter. Shingles are ranked, rare ones
   first; sets of 0.8 share one whose ranks in both leave room for the overlap that 0.8 takes. A copy that has changed
   more than that has only shingles of its own in front, so texts of one origin that are not linked do not meet either.
   Pairs within a component are left out, as they could add nothing.

Defined cases: null and empty texts have the empty set and are one class; a text of up to five words is one shingle;
rows with a null id count like others and are kept only where a class has no id; repeated rows are one node, of which one row
stays; texts of any length are hashed whole; an empty table gives no rows; columns of any name come back as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewatch.llm.common import Scratch, lean, stage, text_batches, text_of
from sievewatch.llm.components import connected_components
from sievewatch.llm.simhash import fingerprint, keep_first, shingle_hashes, trie_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Shingles hashed at a time.
BLOCK = 1 << 12

_DRAWN = np.random.default_rng(17).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_NODE = "id long, text_hash long, node long, size int, fp long, bands array<long>"


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def band_values(shingles: np.ndarray) -> np.ndarray:
    """One hash per band; none for the empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        hashed = (shingles[None, at: at + BLOCK] ^ _DRAWN[0]) * (_DRAWN[1] | np.uint64(1))
        least = np.minimum(least, hashed.min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), seed=k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def _nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(2)]
        # of the distinct shingles, so that a node has one fingerprint
        fps = np.fromiter((fingerprint(s) for s in sets), np.uint64, len(sets))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int32()),
            pa.array(fps.view(np.int64)), pa.array([band_values(s) for s in sets], pa.list_(pa.int64()))],
            names=["id", "text_hash", "node", "size", "fp", "bands"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches SIMILARITY."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(both >= SIMILARITY * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def _trie_candidates(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp): each with the first of its fingerprint, and the first ones of linked fingerprints."""
    firsts = scratch.stage(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    own = nodes.join(firsts, "fp").where("node <> first").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    edges = scratch.stage(trie_links(firsts.select("fp")), "trie-links")
    left, right = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    linked = edges.join(left, "a").join(right, "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return scratch.stage(own.unionAll(linked).distinct(), "trie-pairs")


def _prefixes(open_nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, size, component, other, shingle, pos) of the rarest shingles of each node, those of one node left out."""
    tokens = scratch.stage(sets.join(open_nodes, "node").select("node", "size", "component", "other", F.explode("shingles").alias("shingle")), "tokens")
    rarity = scratch.stage(tokens.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "rarity")
    ranked = tokens.join(rarity, "shingle").groupBy("node", "size", "component", "other").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    own = F.col("size") - F.size("held")  # shingles of this node alone come first
    room = F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-9) + 1 - own
    front = ranked.select("node", "size", "component", "other", own.alias("own"), F.posexplode(F.slice("held", F.lit(1), F.greatest(F.lit(0), room).cast("int"))).alias("at", "front"))
    return scratch.stage(front.select("node", "size", "component", "other", "front.shingle", (F.col("own") + F.col("at")).alias("pos")), "prefixes")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, class) of each row: ``class`` is equal for rows linked directly or through others."""
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-dedup")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("text_hash"), "text")
    rows = scratch.stage(slim.mapInArrow(lean(_nodes), _NODE), "shingled")
    nodes = rows.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = scratch.stage(nodes, "nodes")
    near = _trie_candidates(nodes.select("node", "fp"), scratch)
    held = scratch.stage(nodes.select("node", "text_hash", "size", F.explode("bands").alias("band")), "bands")
    # joined tables are written first: AQE splits a hot band only where both sides come straight from a shuffle
    common = scratch.stage(held.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "common-bands")
    shared = scratch.stage(held.join(common, "band"), "shared-bands")
    popular = scratch.stage(shared.groupBy("node").agg(F.sum("n").alias("popular")), "popular")
    leaders = shared.join(popular, "node").groupBy("band").agg(F.max(F.struct("popular", F.xxhash64("node").alias("h"), "node"))["node"].alias("leader"))
    leaders = scratch.stage(leaders, "leaders")
    asked = shared.select("node").unionAll(near.select("a")).unionAll(near.select("b")).distinct()
    texts = scratch.stage(nodes.select("text_hash", "node").join(asked, "node"), "shared-texts")
    text = docs.select(text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = text.join(texts, "text_hash").select("node", "text").mapInArrow(lean(_sets), "node long, shingles array<long>")
    sets = scratch.stage(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    first = shared.select("band", "node").join(leaders, "band").where("node <> leader").withColumn("other", F.col("leader"))
    walked = scratch.stage(_linked(near, sets), "trie-found")
    held_by = connected_components(walked, "trie-components")
    a_of, b_of = (held_by.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
    first = first.select(*pair).distinct().join(a_of, "a", "left").join(b_of, "b", "left").where(apart).select("a", "b")
    first = scratch.stage(first, "leader-pairs")
    links = scratch.stage(walked.unionAll(_linked(first, sets)), "leader-links")
    joined = connected_components(links, "leader-components")
    # band values that hold several components, with the most common one
    placed = scratch.stage(shared.join(joined, "node", "left").select("band", "node", "size", F.coalesce("component", "node").alias("component")), "placed")
    counts = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    open_ = counts.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component"))["component"].alias("main")).where("parts > 1").select("band", "main")
    placed = placed.join(scratch.stage(open_, "open-bands"), "band")
    open_nodes = placed.groupBy("node", "size", "component").agg(F.max(F.col("component") != F.col("main")).alias("other"))
    front = _prefixes(scratch.stage(open_nodes, "open-nodes"), sets, scratch)
    others = front.where("other").select("shingle", *(F.col(c).alias(f"o_{c}") for c in ("node", "size", "component", "pos")))
    room = F.least(F.col("size") - F.col("pos"), F.col("o_size") - F.col("o_pos"))
    fits = (room >= SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("o_size")) - 1e-9) & (F.col("component") != F.col("o_component"))
    rest = front.drop("other").join(others, "shingle").where(fits).withColumn("other", F.col("o_node"))
    rest = scratch.stage(rest.select(*pair).distinct().join(first, ["a", "b"], "left_anti"), "other-pairs")
    links = scratch.stage(links.unionAll(_linked(rest, sets)), "links")
    joined = connected_components(links, "near-components")
    done = stage(rows.join(joined, "node", "left").select("id", "text_hash", F.coalesce("component", "node").alias("class")), "near-classes")
    scratch.drop()
    return done


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one left of each class: the smallest id (null last), then the smallest text hash."""
    return keep_first(docs, jaccard_classes(docs, id_col, text_col), id_col, text_col)
