"""Graph kernels in numpy: building, pruning and searching one proximity graph in memory.

They hold one partition's vectors, or one query's candidates; the plans deal the
rows. Distances are squared L2, or the negative inner product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from heapq import heappop, heappush

import numpy as np


def distances(q: np.ndarray, x: np.ndarray, metric: str = "l2") -> np.ndarray:
    return -(x @ q) if metric == "inner_product" else ((x - q) ** 2).sum(axis=1)


def medoid(x: np.ndarray) -> int:
    """The row nearest to the mean; the first of several."""
    return int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())


def best_first(start: Iterable[int], dist: Callable[[np.ndarray], np.ndarray], neighbours: Callable[[int], np.ndarray], length: int, beam: int = 1, limit: int | None = None, alive: Callable[[int], bool] | None = None) -> dict:
    """A pool of the `length` best nodes seen, expanded `beam` at a time until all its nodes are.

    alive: nodes that may fill the pool's places; others are travelled through
    without taking a place. limit: the most nodes expanded.
    """
    start = list(dict.fromkeys(int(s) for s in start))
    d0 = dist(np.array(start))
    known = dict(zip(start, map(float, d0), strict=True))
    open_ = [(d, i) for i, d in known.items()]
    open_.sort()
    pool = sorted((d, i) for i, d in known.items() if alive is None or alive(i))
    expanded: list[int] = []
    rounds = 0
    while open_ and (limit is None or len(expanded) < limit):
        bound = pool[length - 1] if len(pool) >= length else (np.inf, -1)
        take = []
        while open_ and len(take) < beam and open_[0] <= bound:
            take.append(heappop(open_)[1])
        if not take:
            break
        rounds += 1
        expanded += take
        new = list(dict.fromkeys(int(v) for u in take for v in neighbours(u) if int(v) not in known))
        if not new:
            continue
        for v, d in zip(new, map(float, dist(np.array(new))), strict=True):
            known[v] = d
            heappush(open_, (d, v))
            if alive is None or alive(v):
                pool.append((d, v))
        pool.sort()
        del pool[length:]
    return {"pool": pool, "expanded": expanded, "known": known, "rounds": rounds, "comparisons": len(known)}


def robust_prune(p: int, ids: np.ndarray, x: np.ndarray, degree: int, alpha: float = 1.2, metric: str = "l2", saturate: bool = False, labels: list[set] | None = None, most: int | None = None) -> list[int]:
    """Neighbours of p among ids: the nearest first, and those that no chosen one occludes at the present slack, which grows to alpha.

    With labels, one node occludes another only if it has all the other's labels. saturate: free places are filled by
    distance, if alpha is over 1. most: only so many nearest ids are looked at.
    """
    ids = np.array([i for i in dict.fromkeys(map(int, ids)) if i != p], dtype=np.int64)
    if not len(ids):
        return []
    d = distances(x[p], x[ids], metric)
    order = np.lexsort((ids, d))[:most]
    ids, d = ids[order], d[order]
    factor, chosen, slack = np.zeros(len(ids)), [], 1.0
    taken = np.zeros(len(ids), dtype=bool)
    while slack <= alpha + 1e-9 and len(chosen) < degree:
        for k in range(len(ids)):
            if len(chosen) >= degree:
                break
            if taken[k] or factor[k] > slack:
                continue
            taken[k], factor[k] = True, np.inf
            chosen.append(int(ids[k]))
            rest = np.flatnonzero(~taken)
            rest = rest[rest > k]
            if labels is not None:
                rest = np.array([r for r in rest if labels[ids[r]] <= labels[ids[k]]], dtype=np.int64)
            if not len(rest):
                continue
            between = distances(x[ids[k]], x[ids[rest]], metric)
            if metric == "inner_product":
                factor[rest] = np.where(between < d[rest], np.maximum(factor[rest], slack + 1e-6), factor[rest])
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    factor[rest] = np.maximum(factor[rest], np.where(between == 0, np.inf, d[rest] / between))
        slack *= SLACK
    if saturate and alpha > 1 and len(chosen) < degree:
        chosen += [int(i) for i in ids if int(i) not in set(chosen)][: degree - len(chosen)]
    return chosen


#: By how much the slack of a pruning grows at a time: below it, one round is all.
SLACK = 1.2


def first_unhidden(ids: np.ndarray, d: np.ndarray, v: np.ndarray, norms: np.ndarray, degree: int) -> np.ndarray:
    """The one round of prune_many() at no slack. ids, d, v, norms: each node's candidates by distance, -1 and infinity where there are fewer."""
    n, m = ids.shape
    # norms + norms' - 2 products are under the distance, by more than rounding, or what rounding makes of copies' zero
    rounding = 2e-12 * norms + 1e-300
    hides = v @ v.transpose(0, 2, 1) > ((norms - np.maximum(d - rounding, rounding)) / 2)[:, None] + (norms / 2)[:, :, None]
    hidden, count = ids < 0, np.zeros(n, dtype=np.int64)
    out = np.full((n, degree), -1, dtype=np.int64)
    for k in range(m):
        r = np.flatnonzero(~hidden[:, k] & (count < degree))
        if not len(r):
            if (count >= degree).all():
                break
            continue
        out[r, count[r]] = ids[r, k]
        count[r] += 1
        hidden[r] |= hides[r, k]
    return out


def prune_many(own: np.ndarray, ids: np.ndarray, x: np.ndarray, degree: int, alpha: float = 1.2, saturate: bool = False) -> np.ndarray:
    """robust_prune() by squared l2 for many nodes at once: (nodes, degree), -1 where there are fewer. ids: each node's candidates, then -1."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    ids[ids == own[:, None]] = -1
    v = x[ids]
    d = ((v - x[own][:, None]) ** 2).sum(axis=2)
    d[ids < 0] = np.inf
    by = np.lexsort((ids, d), axis=-1)
    ids, d = np.take_along_axis(ids, by, axis=1), np.take_along_axis(d, by, axis=1)
    v = x[ids]
    norms = np.einsum("ijk,ijk->ij", v, v)
    if alpha + 1e-9 < SLACK and not (saturate and alpha > 1):
        return first_unhidden(ids, d, v, norms, degree)
    between = norms[:, :, None] + norms[:, None] - 2 * v @ v.transpose(0, 2, 1)
    between[between <= 1e-12 * (norms[:, :, None] + norms[:, None])] = 0  # copies, but for rounding
    n, m = ids.shape
    factor, taken, count = np.where(ids < 0, np.inf, 0.0), np.zeros((n, m), dtype=bool), np.zeros(n, dtype=np.int64)
    out = np.full((n, degree), -1, dtype=np.int64)
    slack = 1.0
    while slack <= alpha + 1e-9:
        for k in range(m):
            r = np.flatnonzero(~taken[:, k] & (factor[:, k] <= slack) & (count < degree))
            if len(r):
                out[r, count[r]] = ids[r, k]
                taken[r, k] = True
                count[r] += 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    hides = np.where(between[r, k, k + 1:] == 0, np.inf, d[r, k + 1:] / between[r, k, k + 1:])
                factor[r, k + 1:] = np.maximum(factor[r, k + 1:], hides)
        slack *= SLACK
    if saturate and alpha > 1:
        for k in range(m):
            r = np.flatnonzero(~taken[:, k] & (ids[:, k] >= 0) & (count < degree))
            out[r, count[r]] = ids[r, k]
            count[r] += 1
    return out


def table(lists: list, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of one array, then -1, and how long each is."""
    count = np.array([len(own) for own in lists], dtype=np.int64)
    out = np.full((len(lists), max(width, int(count.max(initial=0)))), -1, dtype=np.int32)
    out[np.arange(out.shape[1]) < count[:, None]] = np.fromiter((v for own in lists for v in own), dtype=np.int32, count=int(count.sum()))
    return out, count


#: Nodes that are linked at once: at most so many, and one for so many that are linked already. PRUNED: nodes whose lists are pruned at once.
TOGETHER, EACH, PRUNED = 256, 8, 64
#: How many nodes a search expands at once while nodes are linked together.
BEAM = 4


class Vamana:
    """One graph over rows 0..n-1 of x."""

    def __init__(self, x: np.ndarray, degree: int = 32, length: int = 64, alpha: float = 1.2, metric: str = "l2", saturate: bool = False, labels: list[set] | None = None, slack: float = 1.3, book=None):
        """book: searches while building rank by its codes; prunings are exact."""
        self.x, self.degree, self.length, self.alpha, self.metric, self.saturate, self.labels, self.slack = np.asarray(x, dtype=np.float64), degree, length, alpha, metric, saturate, labels, slack
        self.nbrs: list[list[int]] = [[] for _ in range(len(x))]
        self.deleted: set[int] = set()
        self.entries: dict[int, int] = {}
        self.start = medoid(self.x) if len(x) else 0
        self.raw = self.x  # the vectors as they came, where x has them in another shape
        self.book, self.codes = book, None if book is None or not len(x) else book.encode(self.x)

    def choose_entries(self, tries: int = 25, seed: int = 1) -> None:
        """For each label a row where filtered searches begin: of some random rows that have it, the one that fewest labels begin at."""
        members: dict[int, list[int]] = {}
        for i, own in enumerate(self.labels):
            for label in own:
                members.setdefault(label, []).append(i)
        rng, used = np.random.default_rng(seed), {}
        for label in sorted(members):
            some = rng.choice(members[label], size=min(tries, len(members[label])), replace=False).tolist()
            entry = min(some, key=lambda i: (used.get(i, 0), i))
            used[entry], self.entries[label] = used.get(entry, 0) + 1, entry

    def build(self) -> Vamana:
        if self.plain():
            self.link_together(np.array([p for p in range(len(self.x)) if p != self.start], dtype=np.int64), 1)
            return self
        if self.labels is not None:
            self.choose_entries()
        for p in range(len(self.x)):
            if p != self.start:
                self.link(p)
        for p, own in enumerate(self.nbrs):
            if len(own) > self.degree:
                self.nbrs[p] = self.prune(p, own)
        if self.labels is not None:
            self.connect_labels()
        return self

    def plain(self) -> bool:
        """Whether nodes can be linked many at once: l2, without labels."""
        return self.labels is None and self.metric == "l2" and not self.deleted

    def pruned(self, own: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, neighbours) of nodes whose candidates are rows of lists."""
        for a in range(0, len(own), PRUNED):
            yield own[a : a + PRUNED], prune_many(own[a : a + PRUNED], lists[a : a + PRUNED], self.x, self.degree, self.alpha, self.saturate)

    def link_together(self, new: np.ndarray, linked: int) -> None:
        """Enters nodes a block at a time: the nodes of a block search the graph as it is, many at once, are pruned together, and go into the lists of
        what they chose. A block has one node for EACH that are linked already. At the end every node can be reached."""
        from orrery.operators.batch import blocks, by_norms, search_block

        limit = int(self.slack * self.degree)
        near, count = table(self.nbrs, limit)
        x, norms, at = self.x.astype(np.float32), (self.x.astype(np.float32) ** 2).sum(axis=1), 0
        while at < len(new):
            block = new[at : at + max(1, min(TOGETHER, linked // EACH))]
            for part in blocks(len(block), len(near)):
                own = block[part]
                if self.codes is None:
                    score = by_norms("l2", x[own], x, norms)
                else:
                    asked = self.book.prepare(self.x[own])
                    score = lambda rows, nodes, asked=asked: self.book.pairs(asked, rows, self.codes[nodes])
                found = search_block(near, score, [[self.start]] * len(own), self.length, BEAM)
                lists, _ = table([nodes.tolist() for nodes, _ in found.expanded_of(len(own))])
                for nodes, chosen in self.pruned(own, lists):
                    near[nodes, : self.degree] = chosen
                    count[nodes] = (chosen >= 0).sum(axis=1)
            rows, cols = np.nonzero(near[block] >= 0)
            near, count = self.give_back(near, count, near[block][rows, cols].astype(np.int64), block[rows], limit)
            at, linked = at + len(block), linked + len(block)
        long = np.flatnonzero(count > self.degree)
        for nodes, chosen in self.pruned(long, near[long].astype(np.int64)):
            near[nodes] = -1
            near[nodes, : self.degree] = chosen
            count[nodes] = (chosen >= 0).sum(axis=1)
        self.connect(near, count)
        self.nbrs = [row[:n].tolist() for row, n in zip(near, count, strict=True)]

    def give_back(self, near: np.ndarray, count: np.ndarray, to: np.ndarray, node: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges from `to` to `node`, which they don't have yet: lists of over `limit` nodes are pruned."""
        by = np.argsort(to, kind="stable")
        to, node = to[by], node[by]
        who, first = np.unique(to, return_index=True)
        each = np.diff(np.append(first, len(to)))
        fits = count[who] + each <= limit
        place = np.arange(len(to)) - np.repeat(first, each)
        room = np.repeat(fits, each)
        near[to[room], count[to[room]] + place[room]] = node[room]
        count[who[fits]] += each[fits]
        long = who[~fits]
        by_size = np.argsort(each[~fits], kind="stable")
        long, sizes, begin = long[by_size], each[~fits][by_size], first[~fits][by_size]
        for a in range(0, len(long), PRUNED):
            own, width = long[a : a + PRUNED], int(sizes[a : a + PRUNED].max())
            places = np.arange(width)
            more = np.where(places < sizes[a : a + PRUNED, None], node[np.minimum(begin[a : a + PRUNED, None] + places, len(node) - 1)], -1)
            chosen = prune_many(own, np.hstack([near[own].astype(np.int64), more]), self.x, self.degree, self.alpha, self.saturate)
            near[own] = -1
            near[own, : self.degree] = chosen
            count[own] = (chosen >= 0).sum(axis=1)
        return near, count

    def connect(self, near: np.ndarray, count: np.ndarray) -> None:
        """Every node can be reached from the start: where pruning has cut one off, the nearest node that is reached and has a place takes it in, the place of
        its farthest neighbour if its list is full. The edges by which nodes are reached first stay, so nothing else is lost."""
        n = len(near)
        seen, kept = np.zeros(n, dtype=bool), np.zeros(near.shape, dtype=bool)

        def spread(front: np.ndarray) -> None:
            while len(front):
                rows, slots = np.nonzero((near[front] >= 0) & ~seen[near[front]])
                new, first = np.unique(near[front][rows, slots], return_index=True)
                kept[front[rows[first]], slots[first]] = True
                seen[new], front = True, new

        if n:
            seen[self.start] = True
            spread(np.array([self.start]))
        for u in np.flatnonzero(~seen).tolist():
            if seen[u]:
                continue
            may = np.flatnonzero(seen & (kept.sum(axis=1) < self.degree))
            d = ((self.x[may] - self.x[u]) ** 2).sum(axis=1)
            v = int(may[d.argmin()])
            if count[v] < self.degree:
                slot, count[v] = count[v], count[v] + 1
            else:
                free = np.flatnonzero(~kept[v, : count[v]])
                slot = free[((self.x[near[v, free]] - self.x[v]) ** 2).sum(axis=1).argmax()]
            near[v, slot], kept[v, slot], seen[u] = u, True, True
            spread(np.array([u]))

    def connect_all(self) -> None:
        near, count = table(self.nbrs, self.degree)
        self.connect(near, count)
        self.nbrs = [row[:k].tolist() for row, k in zip(near, count, strict=True)]

    def connect_labels(self, only: set | None = None) -> None:
        """Every row of a label (of those in only, if given) can be reached from the one nearest to their mean through rows of the label: where pruning has cut one
        off, the nearest row that a search within the label finds is linked to it, beyond the degree if need be."""
        members: dict[int, list[int]] = {}
        for i, own in enumerate(self.labels):
            if i not in self.deleted:
                for label in own if only is None else own & only:
                    members.setdefault(label, []).append(i)
        for label in sorted(members):
            rows = members[label]
            inside, first = set(rows), rows[medoid(self.x[rows])]
            seen, front, todo = {first}, [first], iter(rows)
            while True:
                while front:
                    new = [v for v in self.nbrs[front.pop()] if v in inside and v not in seen]
                    seen.update(new)
                    front += new
                apart = next((i for i in todo if i not in seen), None)
                if apart is None:
                    break
                near = self.search(self.x[apart], self.length, start=[first], allowed=inside.__contains__)["pool"][0][1]  # of what is reached
                self.nbrs[near].append(apart)
                seen.add(apart)
                front = [apart]

    def prune(self, p: int, ids) -> list[int]:
        ids = [i for i in ids if i not in self.deleted]
        return robust_prune(p, np.array(ids, dtype=np.int64), self.x, self.degree, self.alpha, self.metric, self.saturate, self.labels)

    def search(self, q: np.ndarray, length: int, beam: int = 1, start: list[int] | None = None, allowed=None) -> dict:
        """allowed: nodes that may be travelled at all, as in filtered graphs."""
        near = (lambda u: self.nbrs[u]) if allowed is None else (lambda u: [v for v in self.nbrs[u] if allowed(v)])
        alive = (lambda i: i not in self.deleted) if self.deleted else None
        if self.codes is not None:
            asked = self.book.prepare(q[None])
            dist = lambda ids: self.book.pairs(asked, np.zeros(len(ids), dtype=np.int64), self.codes[ids])
        else:
            dist = lambda ids: distances(q, self.x[ids], self.metric)
        return best_first(start or [self.start], dist, near, length, beam, alive=alive)

    def link(self, p: int) -> None:
        pool = [*self.search(self.x[p], self.length)["expanded"], *self.nbrs[p]]
        if self.labels is not None and self.labels[p]:  # a second search, through rows that share a label alone
            begin = [self.entries.setdefault(label, p) for label in sorted(self.labels[p])]
            begin = [i for i in dict.fromkeys(begin) if i != p]
            if begin:
                own = self.labels[p]
                pool += self.search(self.x[p], self.length, start=begin, allowed=lambda v: bool(self.labels[v] & own))["expanded"]
        self.nbrs[p] = self.prune(p, pool)
        for v in self.nbrs[p]:
            if p not in self.nbrs[v]:
                self.nbrs[v].append(p)
                if len(self.nbrs[v]) > self.slack * self.degree:
                    self.nbrs[v] = self.prune(v, self.nbrs[v])

    # -- updates ---------------------------------------------------------------
    def insert(self, vectors: np.ndarray, labels: list[set] | None = None) -> range:
        """The new nodes' numbers. Each is searched for, pruned and linked back, in turn."""
        first, vectors = len(self.nbrs), np.atleast_2d(np.asarray(vectors, dtype=np.float64))
        if not first:
            self.raw = vectors
        elif self.raw.shape == self.x.shape:  # else who shapes the vectors sets raw as well
            self.raw = np.vstack([self.raw, vectors])
        self.x = np.vstack([self.x, vectors]) if first else vectors
        if self.codes is not None:
            self.codes = np.vstack([self.codes, self.book.encode(vectors)])
        self.nbrs += [[] for _ in vectors]
        if self.labels is not None:
            self.labels = [*self.labels, *(labels or [set() for _ in vectors])]
        if self.plain():
            self.link_together(np.array([p for p in range(first, len(self.nbrs)) if p != self.start], dtype=np.int64), max(1, first))
            return range(first, len(self.nbrs))
        for p in range(first, len(self.nbrs)):
            if p != self.start:
                self.link(p)
        for p, own in enumerate(self.nbrs):
            if len(own) > self.degree:
                self.nbrs[p] = self.prune(p, own)
        if self.labels is not None:
            self.connect_labels(set().union(*self.labels[first:]))
        return range(first, len(self.nbrs))

    def delete(self, p: int) -> None:
        """Lazily: p is travelled through, but never a result, until consolidate()."""
        self.deleted.add(p)

    def consolidate(self) -> int:
        """Neighbours that are deleted give way to their own live neighbours. The number of nodes whose lists changed."""
        changed, long = 0, {}
        for p, own in enumerate(self.nbrs):
            gone = [v for v in own if v in self.deleted]
            if p in self.deleted or not gone:
                continue
            wider = dict.fromkeys([v for v in own if v not in self.deleted] + [w for v in gone for w in self.nbrs[v] if w not in self.deleted and w != p])
            if len(wider) > self.degree and self.labels is None and self.metric == "l2":
                long[p] = list(wider)
            else:
                self.nbrs[p] = list(wider) if len(wider) <= self.degree else self.prune(p, list(wider))
            changed += 1
        by = sorted(long, key=lambda p: len(long[p]))  # lists of a size are pruned together, by what they were before
        for a in range(0, len(by), PRUNED):
            own = by[a : a + PRUNED]
            for p, chosen in zip(own, prune_many(np.array(own), table([long[p] for p in own])[0].astype(np.int64), self.x, self.degree, self.alpha, self.saturate), strict=True):
                self.nbrs[p] = chosen[chosen >= 0].tolist()
        for p in self.deleted:
            self.nbrs[p] = []
        if self.start in self.deleted:
            alive = np.array([i for i in range(len(self.x)) if i not in self.deleted])
            self.start = int(alive[medoid(self.x[alive])]) if len(alive) else 0
        return changed

    def compact(self) -> np.ndarray:
        """Takes the deleted nodes away, after consolidate(), and numbers the others densely. Their former numbers."""
        old = np.array([i for i in range(len(self.x)) if i not in self.deleted], dtype=np.int64)
        new = {int(o): n for n, o in enumerate(old)}
        self.raw = self.raw[old] if len(self.raw) == len(self.x) else self.x[old]
        self.x, self.nbrs = self.x[old], [[new[v] for v in self.nbrs[o]] for o in old]
        if self.labels is not None:
            self.labels = [self.labels[o] for o in old]
        self.start, self.deleted = new.get(self.start, 0), set()
        if self.plain():
            self.connect_all()
        return old


def sphere(n: int, dim: int, radius: float, seed: int = 1) -> np.ndarray:
    """n points on a sphere, uniformly: where searches of a graph that begins empty may start."""
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * radius


def cross_prune(q: np.ndarray, ids: np.ndarray, x: np.ndarray, degree: int) -> list[int]:
    """Of candidates in order of distance, those that no chosen one is as near to as q is. Positions in ids.

    There is no slack: more of it would block more, and what one chosen node blocks stays blocked.
    """
    d = distances(q, x)
    chosen: list[int] = []
    for k in np.lexsort((ids, d)):
        if len(chosen) == degree:
            break
        if not chosen or (distances(x[k], x[chosen]) > d[k]).all():
            chosen.append(int(k))
    return chosen


def refine(q: np.ndarray, pool: list[tuple[float, int]], vector: Callable[[np.ndarray], np.ndarray], k: int, mode: str = "full", batch: int = 50, streak: int = 2, count: int = 0, ratio: float = 1.0, exact: Callable = distances) -> tuple[list[tuple[float, int, bool]], int]:
    """Exact distances for a pool in order of approximate ones: the best k as (dist, id, refined), and how many were refined.

    mode: full; early_exit, when the k best ids of the whole pool, by exact distances as far as they are known and approximate
    ones beyond, stay the same for `streak` batches; fixed_count; fixed_ratio (at least k).
    """
    ids = np.array([i for _, i in pool], dtype=np.int64)
    n = {"full": len(ids), "early_exit": len(ids), "fixed_count": min(count, len(ids)), "fixed_ratio": min(len(ids), max(k, int(np.ceil(ratio * len(ids)))))}[mode]
    present = {i: (d, False) for d, i in pool}
    best = lambda: sorted((d, i, r) for i, (d, r) in present.items())[:k]
    same, before, done = 0, {i for _, i, _ in best()}, 0
    while done < n:
        part = ids[done:min(done + batch, n)] if mode == "early_exit" else ids[:n]
        present.update((int(i), (float(d), True)) for d, i in zip(exact(q, vector(part)), part, strict=True))
        done += len(part)
        if mode == "early_exit":
            now = {i for _, i, _ in best()}
            same, before = same + 1 if now == before else 0, now
            if same >= streak:
                break
    return best(), done
