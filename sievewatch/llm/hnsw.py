"""Hierarchical navigable small-world graphs as flat neighbour arrays, built and searched for many vectors in step.

Nodes are ordered by level, highest first, so a layer is a prefix of the nodes and one int32 array of neighbours.
Layers are built from the top down; vectors enter in batches that search what is there already and each other. Links are
chosen by the usual rule (a candidate stays if it is closer to the node than to any neighbour chosen before it) and
free places are filled with the nearest of the rest. Nearness is the inner product, of unit vectors for cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

M = 16
BUILD_BEAM = 64
CORE = 256
BATCH = 2048
#: Flags of visited nodes held at a time, and vectors compared at a time.
FLAGS = 1 << 26
ROWS = 4096
#: Queries searched in step, and nodes of a beam that are opened together.
STEP = 256
OPENED = 8
#: Products taken at a time.
PIECE = 1024
#: A free place in a beam; its lowest bit counts it as opened.
NOTHING = np.int64(np.iinfo(np.int64).min + 1)


@dataclass
class Graph:
    vectors: np.ndarray  # float32, n x d
    layers: list[np.ndarray]  # neighbours of layer 0, 1, ...; layer k has the first len(layers[k]) nodes


def levels(n: int, seed: int) -> np.ndarray:
    """Levels of n nodes, highest first."""
    drawn = np.random.default_rng(seed).random(n)
    return np.sort((-np.log(1 - drawn) / np.log(M)).astype(np.int64))[::-1]


def build(vectors: np.ndarray, seed: int = 0, beam: int = BUILD_BEAM) -> Graph:
    n = len(vectors)
    graph = Graph(np.ascontiguousarray(vectors, np.float32), [])
    level = levels(n, seed)
    upper: list[np.ndarray] = []
    for k in range(int(level[0]) if n else 0, -1, -1):
        size = int((level >= k).sum())
        layer = np.full((size, 2 * M if k == 0 else M), -1, np.int32)
        core = min(size, CORE)
        ids = np.arange(core)
        near = graph.vectors[ids] @ graph.vectors[ids].T
        np.fill_diagonal(near, -np.inf)
        _link(graph.vectors, layer, ids, np.tile(ids.astype(np.int32), (core, 1)), near)
        done = core
        while done < size:
            new = np.arange(done, min(size, done + min(done, BATCH)))
            found, near = search(Graph(graph.vectors, [layer, *upper]), graph.vectors[new], beam)
            own = graph.vectors[new] @ graph.vectors[new].T
            np.fill_diagonal(own, -np.inf)
            width = min(beam // 2, len(new))
            best = np.argpartition(-own, width - 1, axis=1)[:, :width]
            found = np.concatenate([found, new[best].astype(np.int32)], axis=1)
            near = np.concatenate([near, np.take_along_axis(own, best, axis=1)], axis=1)
            _link(graph.vectors, layer, new, found, near)
            done += len(new)
        upper = [layer, *upper]
    graph.layers = upper
    return graph


def _link(vectors: np.ndarray, layer: np.ndarray, nodes: np.ndarray, found: np.ndarray, near: np.ndarray) -> None:
    """Link ``nodes`` to the chosen of their candidates, and these back."""
    width = layer.shape[1]
    layer[nodes] = _choose(vectors, found, near, width)
    back, ends = layer[nodes].ravel(), np.repeat(nodes, width)
    real = back >= 0
    back, ends = back[real], ends[real]
    order = np.argsort(back, kind="stable")
    back, ends = back[order], ends[order]
    hosts, first, count = np.unique(back, return_index=True, return_counts=True)
    place = np.arange(len(back)) - np.repeat(first, count)
    for at in range(0, len(hosts), ROWS):
        some = hosts[at: at + ROWS]
        a, b = first[at], first[at] + count[at: at + ROWS].sum()
        extra = np.full((len(some), int(count[at: at + ROWS].max())), -1, np.int32)
        extra[np.repeat(np.arange(len(some)), count[at: at + ROWS]), place[a:b]] = ends[a:b]
        held = np.concatenate([layer[some], extra], axis=1)
        held[:, width:][(held[:, width:, None] == held[:, None, :width]).any(axis=2)] = -1  # linked already
        near = np.where(held >= 0, _products(vectors, some, held), -np.inf).astype(np.float32)
        layer[some] = _choose(vectors, held, near, width)


def _products(vectors: np.ndarray, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = np.empty(others.shape, np.float32)
    for at in range(0, len(nodes), 512):
        out[at: at + 512] = np.einsum("rd,rcd->rc", vectors[nodes[at: at + 512]], vectors[others[at: at + 512]])
    return out


def _choose(vectors: np.ndarray, found: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` neighbours of each row, those that the rule chooses first; -1 pads."""
    most = min(found.shape[1], 2 * width + 32)
    out = np.full((len(found), width), -1, np.int32)
    for at in range(0, len(found), 512):
        order = np.argsort(-near[at: at + 512], axis=1, kind="stable")[:, :most]
        ids, sims = np.take_along_axis(found[at: at + 512], order, axis=1), np.take_along_axis(near[at: at + 512], order, axis=1)
        real = (ids >= 0) & np.isfinite(sims)
        held = vectors[ids]
        mutual = held @ held.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        closest, count = np.full(ids.shape, -np.inf, np.float32), np.zeros(len(ids), np.int64)
        for c in range(ids.shape[1]):
            chosen[:, c] = real[:, c] & (closest[:, c] < sims[:, c]) & (count < width)
            now = np.nonzero(chosen[:, c])[0]
            count[now] += 1
            closest[now, c + 1:] = np.maximum(closest[now, c + 1:], mutual[now, c, c + 1:])
        first = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :width]
        got = np.where(np.take_along_axis(real, first, axis=1), np.take_along_axis(ids, first, axis=1), -1)
        out[at: at + 512, : got.shape[1]] = got
    return out


def search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query and their products, nearest first; -1 and -inf pad."""
    n = len(graph.layers[0])
    beam = min(beam, n)
    ids, near = np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), -np.inf, np.float32)
    step = max(16, min(STEP, FLAGS // max(1, n)))
    for at in range(0, len(queries), step):
        part = np.ascontiguousarray(queries[at: at + step], np.float32)
        start = np.zeros((len(part), 1), np.int32)
        for layer in reversed(graph.layers[1:]):
            start = _beam(graph.vectors, layer, part, start, 1)[0]
        ids[at: at + step], near[at: at + step] = _beam(graph.vectors, graph.layers[0], part, start, beam)
    return ids, near


def _each(vectors: np.ndarray, nodes: np.ndarray, queries: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Product of each node with its query, in pieces that stay in the cache."""
    out = np.empty(len(nodes), np.float32)
    held, asked = np.empty((PIECE, vectors.shape[1]), np.float32), np.empty((PIECE, vectors.shape[1]), np.float32)
    for at in range(0, len(nodes), PIECE):
        n = min(PIECE, len(nodes) - at)
        np.take(vectors, nodes[at: at + n], axis=0, out=held[:n], mode="clip")
        np.take(queries, of[at: at + n], axis=0, out=asked[:n], mode="clip")
        np.einsum("rd,rd->r", held[:n], asked[:n], out=out[at: at + n])
    return out


def _keys(near: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """One integer for each product and node, in the order of the products; the lowest bit is free."""
    bits = near.view(np.int32).astype(np.int64)
    return (bits ^ (bits >> 31 & 0x7FFFFFFF)) << 32 | nodes.astype(np.int64) << 1


def _beam(vectors: np.ndarray, layer: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: each opens its OPENED nearest unopened nodes until all of its beam is open.

    A beam is kept as unordered keys whose lowest bit tells that a node has been opened. With several nodes opened at once,
    the work that each step does on whole beams grows less with their length.
    """
    q, opened = len(queries), min(OPENED, beam)
    held = np.full((q, beam), NOTHING)
    held[:, 0] = _keys(np.einsum("rd,rd->r", queries, vectors[start[:, 0]]), start[:, 0])
    seen = np.zeros((q, len(layer)), bool)
    seen[np.arange(q), start[:, 0]] = True
    live = np.arange(q)
    while len(live):
        keys = held[live]
        shut = np.where(keys & 1, NOTHING, keys)
        best = np.partition(shut, beam - opened, axis=1)[:, beam - opened:]
        on = best != NOTHING
        some = on.any(axis=1)
        if not some.all():
            live, keys, shut, best, on = live[some], keys[some], shut[some], best[some], on[some]
            if not len(live):
                break
        keys |= shut >= best.min(axis=1)[:, None]
        around = np.where(on[:, :, None], layer[(best & 0xFFFFFFFF) >> 1], -1).reshape(len(live), -1)
        around.sort(axis=1)
        fresh = (around >= 0) & ~seen[live[:, None], around]
        fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
        row, col = np.nonzero(fresh)
        nodes = around[row, col]
        seen[live[row], nodes] = True
        sims = _keys(_each(vectors, nodes, queries, live[row]), nodes)
        better = sims > keys.min(axis=1)[row]
        row, sims = row[better], sims[better]
        count = np.bincount(row, minlength=len(live))
        added = np.full((len(live), int(count.max())), NOTHING)
        added[row, np.arange(len(row)) - (np.cumsum(count) - count)[row]] = sims
        held[live] = np.partition(np.concatenate([keys, added], axis=1), added.shape[1], axis=1)[:, added.shape[1]:] if len(row) else keys
    held = -np.sort(-held, axis=1)
    bits = held >> 32
    near = (bits ^ (bits >> 31 & 0x7FFFFFFF)).astype(np.int32).view(np.float32)
    real = held != NOTHING
    return np.where(real, (held & 0xFFFFFFFF) >> 1, -1).astype(np.int32), np.where(real, near, np.float32(-np.inf))
