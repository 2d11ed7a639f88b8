"""Searching one graph for many queries at once, in numpy.

Queries go forward together, a round at a time: each takes the best nodes of its
pool that it hasn't expanded, up to its beam, and their unseen neighbours are
ranked for all queries by one product of vectors with stored norms, or by one
look at a quantiser's codes. A round is a few array operations for a block of
queries, and what it finds is the same as for each query alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

METRICS = ("l2", "inner_product", "cosine")
#: What a block of queries may hold of marks, four bytes for each query and node.
MARKS = 1 << 24
#: A beam that widens begins with so many nodes, and widens while at most WASTE of what it expands falls out of the pool.
#: Widening, and counting down to the early end, begin when the SETTLED best of the pool are expanded.
NARROW, WASTE, SETTLED = 4, 0.1, 5


def padded(offsets: np.ndarray, nbrs: np.ndarray) -> np.ndarray:
    """(nodes, largest degree): each node's neighbours, then -1."""
    degree = np.diff(offsets)
    out = np.full((len(degree), int(degree.max(initial=0))), -1, dtype=np.int32)
    out[np.arange(out.shape[1]) < degree[:, None]] = nbrs
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def shaped(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors among which squared l2 orders as the metric does for a query: unit vectors for cosine; for the inner product one more

    dimension, by which all have the largest norm.
    """
    if metric == "cosine":
        return unit(x)
    if metric == "inner_product":
        norms = (x * x).sum(axis=1)
        return np.hstack([x, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]])
    return x


def exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of pairs, row by row."""
    if metric == "l2":
        return ((x - q) ** 2).sum(axis=-1)
    dot = (x * q).sum(axis=-1)
    if metric == "inner_product":
        return -dot
    both = np.sqrt((x * x).sum(axis=-1) * (q * q).sum(axis=-1))
    return np.where(both == 0, 1.0, 1.0 - dot / np.where(both == 0, 1.0, both))


def by_norms(metric: str, queries: np.ndarray, x: np.ndarray, norms: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of pairs (query, node) from products and stored squared norms. Without the query's own norm, if it doesn't change the order."""
    if metric == "cosine":
        queries, scale = unit(queries), 1 / np.sqrt(np.maximum(norms, 1e-30))
        return lambda rows, at: 1 - np.einsum("ij,ij->i", queries[rows], x[at]) * scale[at]
    if metric == "inner_product":
        return lambda rows, at: -np.einsum("ij,ij->i", queries[rows], x[at])
    own = (queries * queries).sum(axis=1)
    return lambda rows, at: norms[at] + own[rows] - 2 * np.einsum("ij,ij->i", queries[rows], x[at])


@dataclass
class Found:
    """By query: the pool's nodes and distances (nearest first, -1 and infinity where there are none), and the work done."""

    nodes: np.ndarray
    dists: np.ndarray
    rounds: np.ndarray
    expanded: np.ndarray
    comparisons: np.ndarray
    trail: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # (query, node, distance) of what was expanded

    def expanded_of(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes and distances that each of n queries expanded, in order."""
        rows, nodes, dists = (np.concatenate([t[i] for t in self.trail] or [np.zeros(0, dtype=np.int64)]) for i in range(3))
        by = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[by], np.arange(n + 1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield nodes[by[a:b]], dists[by[a:b]]


#: A place of a pool in which there is nothing, and the bit of what has been expanded.
EMPTY, DONE = np.uint64(2**64 - 1), np.uint64(1)
#: The bit of a number's sign, and how far up a place has its distance.
SIGN, HIGH = np.uint32(1 << 31), np.uint64(32)


def packed(dists: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Places of a pool that sort by distance, in single precision, then node (of fewer than 2^31); the last bit is DONE."""
    bits = (dists.astype(np.float32) + np.float32(0)).view(np.uint32)
    bits = np.where(bits & SIGN, ~bits, bits | SIGN)
    return (bits.astype(np.uint64) << HIGH) | (nodes.astype(np.uint64) << DONE)


def nodes_of(places: np.ndarray) -> np.ndarray:
    return ((places & np.uint64(0xFFFFFFFF)) >> DONE).astype(np.int64)


def dists_of(places: np.ndarray) -> np.ndarray:
    bits = (places >> HIGH).astype(np.uint32)
    return np.where(places == EMPTY, np.inf, np.where(bits & SIGN, bits & ~SIGN, ~bits).view(np.float32).astype(np.float64))


def search_block(near: np.ndarray, score: Callable, starts: list[list[int]], length: int, beam: int = 8, limit: int | None = None, alive: np.ndarray | None = None, allowed: np.ndarray | None = None, widen: bool = False, patience: int = 0) -> Found:
    """The `length` best nodes that each query sees. score(rows, nodes): distances of pairs; starts: nodes by query.

    alive: which nodes may fill a pool's places; others are travelled through. allowed: which may be travelled at all. limit: a query
    ends when it has expanded so many. widen: the beam begins with NARROW nodes, and grows to `beam` while little is wasted.
    patience: a query ends so many expansions after its SETTLED best were expanded first; 0: when its pool is expanded.
    """
    n, m = len(near), len(starts)
    marks = np.zeros(m * n, dtype=np.int32)
    out = Found(np.full((m, 0), -1), np.full((m, 0), np.inf), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64))
    width = np.full(m, min(NARROW, beam) if widen else beam)
    tried, wasted, settled = np.zeros(m), np.zeros(m), np.full(m, -1)
    # The pool's places as numbers in order (see packed()), dead nodes among them, up to the length-th that is alive.
    pool = np.full((m, 1), EMPTY)

    def enter(rows: np.ndarray, fresh: np.ndarray) -> None:
        """Pairs, each query's together, that are new: rank them, and merge them into the pools."""
        nonlocal pool
        d = score(rows, fresh)
        out.comparisons[:] += np.bincount(rows, minlength=m)
        key = packed(d, fresh)
        keep = np.isfinite(d)
        if alive is None and pool.shape[1] >= length:
            keep &= key < pool[rows, length - 1]
        rows, key = rows[keep], key[keep]
        if not len(rows):
            return
        who, first = np.unique(rows, return_index=True)
        each = np.diff(np.append(first, len(rows)))
        at = np.arange(len(rows)) - np.repeat(first, each)
        new = np.full((len(who), int(each.max())), EMPTY)
        new[np.repeat(np.arange(len(who)), each), at] = key
        both = np.sort(np.hstack([pool[who], new]), axis=1)
        if alive is not None:
            counts = (both != EMPTY) & alive[np.where(both != EMPTY, nodes_of(both), 0)]
            both[np.cumsum(counts, axis=1) - counts >= length] = EMPTY
        both = both[:, : int((both != EMPTY).sum(axis=1).max()) if alive is not None else length]
        if both.shape[1] > pool.shape[1]:
            pool = np.pad(pool, ((0, 0), (0, both.shape[1] - pool.shape[1])), constant_values=EMPTY)
        pool[who, : both.shape[1]] = both
        pool[who, both.shape[1] :] = EMPTY

    def unseen(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = rows.astype(np.int64) * n + nodes
        key = key[marks[key] == 0]
        order = np.arange(1, len(key) + 1, dtype=np.int32)
        marks[key] = order
        key = key[marks[key] == order]  # of the same pair twice the last stays
        return (key // n).astype(np.int64), key % n

    first = [(r, v) for r, own in enumerate(starts) for v in dict.fromkeys(own)]
    if first and n:
        enter(*unseen(*np.array(first, dtype=np.int64).T))
    while True:
        open_ = (pool & DONE) == 0
        if limit is not None:
            open_[out.expanded >= limit] = False
        if patience:
            open_[(settled >= 0) & (out.expanded >= settled + patience)] = False
        take = open_ & (np.cumsum(open_, axis=1, dtype=np.int32) <= width[:, None])
        rows, cols = np.nonzero(take)
        if not len(rows):
            break
        pool |= take
        at, at_dist = nodes_of(pool[rows, cols]), dists_of(pool[rows, cols])
        out.trail.append((rows, at, at_dist))
        n_taken = np.bincount(rows, minlength=m)
        out.expanded += n_taken
        out.rounds += n_taken > 0
        reach = near[at]
        ok = reach >= 0
        if allowed is not None:
            ok &= allowed[reach]
        pairs = unseen(np.repeat(rows, ok.sum(axis=1)), reach[ok])
        if len(pairs[0]):
            enter(*pairs)
        if widen or patience:
            ready = (pool[:, : min(SETTLED, pool.shape[1])] & DONE).all(axis=1)
            settled = np.where((settled < 0) & ready, out.expanded, settled)
            if widen:
                last = dists_of(pool[:, min(length, pool.shape[1]) - 1])
                counted = ready[rows]
                tried += np.bincount(rows[counted], minlength=m)
                wasted += np.bincount(rows[counted & (at_dist > last[rows])], minlength=m)
                width = np.where((tried > 0) & (wasted <= WASTE * tried), np.minimum(width + 1, beam), width)
    if alive is not None:
        pool[(pool != EMPTY) & ~alive[np.where(pool != EMPTY, nodes_of(pool), 0)]] = EMPTY
        pool.sort(axis=1)
    pool = pool[:, :length]
    out.nodes, out.dists = np.where(pool == EMPTY, -1, nodes_of(pool)), dists_of(pool)
    return out


def blocks(queries: int, nodes: int) -> Iterator[slice]:
    """Slices of queries whose marks are bounded."""
    size = max(1, min(256, MARKS // max(nodes, 1)))
    for at in range(0, queries, size):
        yield slice(at, min(at + size, queries))


def refine_all(metric: str, queries: np.ndarray, x: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each query's nodes by exact distances, as (nodes, distances)."""
    there = nodes >= 0
    d = np.full(nodes.shape, np.inf)
    rows, cols = np.nonzero(there)
    d[rows, cols] = exact(metric, queries[rows], x[nodes[rows, cols]])
    by = np.lexsort((nodes, d), axis=-1)[:, :k]
    return np.take_along_axis(nodes, by, axis=1), np.take_along_axis(d, by, axis=1)
