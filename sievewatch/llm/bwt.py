"""Repeats of a least length in a collection of byte strings: threshold-bounded interval expansion on a BWT.

The suffixes are sorted by their first ``least`` symbols (prefix doubling), which is all that a Burrows-Wheeler
transform needs for patterns up to that length. Intervals of the suffix order are then extended backwards, one symbol
and one level at a time: the interval of a pattern of length l + 1 ends where neighbouring suffixes share exactly l
symbols, unless a shorter pattern has ended there before. So common prefixes come out by increasing value. The walk
stops at ``least``; ends that were never set belong to neighbours that share ``least`` symbols or more.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0
#: Symbols packed into the first sorting key: 257 ** 7 < 2 ** 63.
PACKED = 7


def sorted_suffixes(symbols: np.ndarray, least: int) -> np.ndarray:
    """Suffix positions ordered by their first ``least`` symbols at least."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(PACKED, symbols.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(PACKED):
        key = key * 257 + padded[k: k + n]
    order = np.argsort(key)
    rank, start = _ranks(key, order)
    width = PACKED
    while width < least:
        again = start[1:] - start[:-1] > 1  # only classes with several members are sorted again
        if not again.any():
            break
        sizes = start[1:] - start[:-1]
        places = np.nonzero(np.repeat(again, sizes))[0]
        at = order[places]
        ahead = at + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key)
        order[places] = at[by]
        # a class keeps its first place as rank, its parts take the places where they begin
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[places]] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        start = np.concatenate([np.nonzero(np.concatenate([[True], rank[order[1:]] != rank[order[:-1]]]))[0], [n]])
        width *= 2
    return order


def _ranks(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held = key[order]
    first = np.nonzero(np.concatenate([[True], held[1:] != held[:-1]]))[0]
    start = np.concatenate([first, [len(key)]])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.repeat(first, start[1:] - start[:-1])
    return rank, start


def repeated_starts(symbols: np.ndarray, least: int) -> np.ndarray:
    """True where the ``least`` symbols from here, none a separator, also start elsewhere. Symbols (uint16): 1 to 256; 0 separates and comes last."""
    n = len(symbols)
    out = np.zeros(n, bool)
    if n <= least:
        return out
    order = sorted_suffixes(symbols, least)
    bwt = symbols[order - 1]  # position 0 wraps round to the last symbol, a separator: no pattern is extended by one
    by_symbol = np.argsort(bwt, kind="stable")
    bwt = bwt.astype(np.int64)
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    ended = np.zeros(n + 1, bool)
    ended[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for level in range(least):
        if not len(low):
            break
        sizes = high - low
        own = np.repeat(np.arange(len(low)), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[own]
        if level:  # a separator may end a pattern, but stands nowhere else in one
            real = bwt[place] != SEPARATOR
            own, place = own[real], place[real]
        last, first = after[place] >= high[own], before[place] < low[own]
        tops, bottoms = lf[place[last]] + 1, lf[place[first]]
        symbol_of = own * 257
        tops = tops[np.argsort(symbol_of[last] + bwt[place[last]])]
        bottoms = bottoms[np.argsort(symbol_of[first] + bwt[place[first]])]
        fresh = ~ended[tops]
        tops, bottoms = tops[fresh], bottoms[fresh]
        ended[tops] = True
        low, high = bottoms, tops
    shared = ~ended[1:n]
    out[order[1:][shared]] = True
    out[order[:-1][shared]] = True
    cuts = np.nonzero(symbols == SEPARATOR)[0]
    return out & (cuts[np.searchsorted(cuts, np.arange(n))] - np.arange(n) >= least)
