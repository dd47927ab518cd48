"""K-d tree partitioning into shards of near equal bytes, in DataFrame operations only.

Points are groups of equal texts, with their bytes as weight and three metadata dimensions: the size of the text, the
first id of the group and its source. A node that stands for m shards is cut along its widest dimension (its range as a
share of the whole range) at the weighted quantile m // 2 : m, until each leaf is one shard. Quantiles of all nodes of a
level are found together by refining histograms: at most ``n_shards * BINS`` rows reach the driver in each round. Points
with the same value are told apart by a hash, so that a cut always finds its place.

Equal texts stay in one shard, unless their bytes exceed ``SLACK`` of a shard; such a group is cut into pieces of about
that size by a hash of the id, since no law of near equal bytes could hold otherwise.

Slots count within a shard: rows are numbered within hashed sub-buckets of about SLOT_ROWS rows, whose first slots come
from a running sum over bucket counts, so no task numbers a whole shard.

Defined cases: a null text has no bytes, size 16 and CRC-32 0, and groups with empty texts; a null id counts as the
smallest; a null source as an empty one; repeated rows get slots of their own; with fewer groups than shards some shards
stay empty; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewatch.llm.common import stage, text_of

SHARDS = 40
OVERHEAD = 16
BINS = 1024
SLACK = 0.02
SLOT_ROWS = 2048
KEYS = ("k_size", "k_id", "k_source")


@dataclass
class Node:
    """Shards first .. first + shards - 1; a cut sends keys below ``cut`` of dimension ``key`` to the left."""

    first: int
    shards: int
    key: str | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def leaf_of(node: Node) -> Column:
    """First shard of the leaf that a point falls into."""
    if node.left is None or node.right is None:
        return F.lit(node.first)
    return F.when(F.col(node.key) < node.cut, leaf_of(node.left)).otherwise(leaf_of(node.right))


def keyed_rows(docs: DataFrame, n_shards: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, size, text_crc32, text_hash, keys): keys are equal for the rows of a point."""
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), F.crc32(F.coalesce(F.col(source_col).cast("string"), F.lit("")).cast("binary")).alias("source_code"),
    )
    rows = stage(rows, "sizes")
    group = ["text_hash", "text_crc32", "size"]
    groups = rows.groupBy(*group).agg(F.sum("size").alias("bytes"), F.min("id").alias("first_id"), F.min("source_code").alias("first_source"))
    groups = stage(groups, "equal-texts")
    total, low, high = groups.agg(F.sum("bytes"), F.min("first_id"), F.max("first_id")).first()
    piece = max(1, int((total or 0) / n_shards * SLACK))
    pieces = F.ceil(F.col("bytes") / piece)
    part = F.when(F.col("bytes") > piece, F.pmod(F.xxhash64("id", "text_hash"), pieces)).otherwise(0)
    low, span = low or 0, max(1, (high or 0) - (low or 0))
    # 30 bits of value, then 32 bits of the point's hash
    point = F.xxhash64(*group, part).bitwiseAND(0xFFFFFFFF)
    place = F.coalesce((F.col("first_id") - low).cast("double") / span, F.lit(0.0)) * ((1 << 30) - 1)
    values = (F.least("size", F.lit((1 << 30) - 1)), place.cast("long"), F.shiftright("first_source", 2))
    keys = [F.shiftleft(v.cast("long"), 32).bitwiseOR(point).alias(k) for k, v in zip(KEYS, values, strict=True)]
    return stage(rows.join(groups, group).select("id", "size", "text_crc32", "text_hash", *keys), "points")


def _quantiles(points: DataFrame, root: Node, nodes: list[Node]) -> None:
    """Choose dimension and cut of each node, all together."""
    leaf = leaf_of(root)
    bounds = [F.min(k).alias(f"low_{k}") for k in KEYS] + [F.max(k).alias(f"high_{k}") for k in KEYS]
    ranges = {r["leaf"]: r for r in points.groupBy(leaf.alias("leaf")).agg(F.sum("weight").alias("weight"), *bounds).collect()}  # a row per node
    whole = {k: max([1, *((r[f"high_{k}"] >> 32) for r in ranges.values())]) - min([0, *((r[f"low_{k}"] >> 32) for r in ranges.values())]) for k in KEYS}
    search = {}
    for node in nodes:
        r = ranges.get(node.first)
        if r is None:
            node.key = KEYS[0]
            continue
        node.key = max(KEYS, key=lambda k: ((r[f"high_{k}"] >> 32) - (r[f"low_{k}"] >> 32)) / whole[k])
        low, high = r[f"low_{node.key}"], r[f"high_{node.key}"]
        node.cut = high + 1
        if low < high:  # else one point: it goes left
            search[node.first] = [node, low, high, r["weight"] * (node.shards // 2) / node.shards, 0]
    while search:
        # each open node looks at one range of its keys, in BINS equal steps
        value, low, width = F.lit(None), F.lit(None), F.lit(None)
        for first, (node, lo, hi, _, _) in search.items():
            here = leaf == first
            value, low = F.when(here & F.col(node.key).between(lo, hi), F.col(node.key)).otherwise(value), F.when(here, F.lit(lo)).otherwise(low)
            width = F.when(here, F.lit((hi - lo) // BINS + 1)).otherwise(width)
        binned = points.select(leaf.alias("leaf"), value.cast("long").alias("v"), low.cast("long").alias("lo"), width.cast("long").alias("step"), "weight").where("v IS NOT NULL")
        bins = binned.groupBy("leaf", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("weight").alias("weight"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        by_leaf: dict[int, list] = {}
        for b in sorted(bins, key=lambda b: (b["leaf"], b["bin"])):
            by_leaf.setdefault(b["leaf"], []).append(b)
        again = {}
        for first, (node, _, _, goal, below) in search.items():
            for b in by_leaf[first]:
                if below + b["weight"] >= goal or b is by_leaf[first][-1]:
                    if b["least"] == b["most"]:  # one point: left or right of the cut, whichever is closer to the goal
                        node.cut = b["least"] + (goal - below > below + b["weight"] - goal)
                    else:
                        again[first] = [node, b["least"], b["most"], goal, below]
                    break
                below += b["weight"]
        search = again


def kd_tree(points: DataFrame, n_shards: int) -> Node:
    """``points``: keys and weight -> the tree, found level by level."""
    root = Node(0, n_shards)
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        _quantiles(points, root, level)
        for n in level:
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
        level = [x for n in level for x in (n.left, n.right)]
    return root


def kd_shards(docs: DataFrame, n_shards: int | None = SHARDS, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row; ``target_bytes`` sets the number of shards by the bytes there are."""
    if target_bytes is not None:
        total = docs.agg(F.sum(F.octet_length(text_of(text_col)) + OVERHEAD)).first()[0] or 0
        n_shards = max(1, ceil(total / target_bytes))
    rows = keyed_rows(docs, n_shards, id_col, text_col, source_col)
    points = stage(rows.groupBy(*KEYS).agg(F.sum("size").alias("weight")), "weights")
    placed = rows.select("id", "size", "text_crc32", "text_hash", leaf_of(kd_tree(points, n_shards)).alias("shard"))
    return _with_slots(placed, n_shards)


def _with_slots(placed: DataFrame, n_shards: int) -> DataFrame:
    counts = dict(placed.groupBy("shard").count().collect())  # a row per shard
    buckets = F.element_at(F.array(*(F.lit(ceil(counts.get(s, 0) / SLOT_ROWS) or 1) for s in range(n_shards))), F.col("shard") + 1)
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "text_hash"), buckets))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stage(sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot")), "slots")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_hash"))
    numbered = rows.withColumn("number", number - 1)
    return numbered.join(firsts, ["shard", "bucket"]).select("id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("number")).alias("slot"))
