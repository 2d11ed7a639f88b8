"""Searching a graph that is too large for one machine: partitions answer, and their best are merged.

Each partition's graph is searched where it lies, for all queries or for those
that are sent to it (plans.routing), many at once, and the k best of all
partitions are taken. search_partitions() ranks by quantised
distances and refines with exact ones; sweep() measures it over pool lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.batch import Found, blocks, by_norms, exact, padded, refine_all, search_block
from orrery.operators.kernels import refine
from orrery.operators.knn import approximate, merge_top_k, query_blocks
from orrery.operators.quantise import Quantiser
from orrery.operators.recall import recall_with_ties
from orrery.plans.build import rows_of

MODES = ("full", "early_exit", "fixed_count", "fixed_ratio", "expanded")


@dataclass(frozen=True)
class SearchParams:
    """mode: which candidates get exact distances; expanded: every node that the search expanded. entries: how many random starting points besides the medoid.

    widen: the beam begins narrow, and grows to `beam` while at most a tenth of what it expands falls out of the pool. patience: a
    query ends so many expansions after its first five were expanded, not when all its pool is (0). check: an exact check follows the search
    (Searchable.checked()).
    """

    k: int = 10
    length: int = 100
    beam: int = 8
    limit: int | None = None
    mode: str = "full"
    batch: int = 50
    streak: int = 2
    count: int = 0
    ratio: float = 1.0
    entries: int = 0
    widen: bool = False
    patience: int = 0
    check: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not 0 < self.k <= self.length:
            raise ValueError("k must be positive and at most length")
        if self.beam < 1:
            raise ValueError("beam must be positive")
        if self.entries < 0 or self.count < 0 or self.patience < 0 or not 0 <= self.ratio <= 1:
            raise ValueError("entries, count and patience can't be negative, and ratio is from 0 to 1")


RESULT = "qid bigint, id bigint, dist double, refined boolean, expanded bigint, rounds bigint, comparisons bigint, n_refined bigint, reached bigint, missed bigint, added boolean"


def with_ids(local: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """local with an array column of those of the ids (id) that each partition has; null if it has none."""
    own = local.select("part", F.explode("ids").alias("id")).join(ids.select("id"), "id", "left_semi").groupBy("part").agg(F.collect_list("id").alias(name))
    return local.join(own, "part", "left")


def known_labels(local: DataFrame, asked: DataFrame, label: str, universal: int | None) -> None:
    """Raises if a query asks for a label that no partition has."""
    missing = asked.select(F.col(label).cast("int").alias("label")).distinct().join(local.select(F.explode("label_ids").alias("label")).distinct(), "label", "left_anti")
    if universal is not None and local.filter(F.array_contains("label_ids", universal)).limit(1).count():
        return  # rows of the universal label answer any query
    found = [r.label for r in missing.limit(5).collect()]
    if found:
        raise ValueError(f"no row has the labels {found}")


class Searchable:
    """A row of GRAPHS, opened for many queries."""

    def __init__(self, row: dict):
        self.part, self.ids, self.n = row["part"], np.asarray(row["ids"], dtype=np.int64), len(row["ids"])
        offsets, nbrs = np.asarray(row["offsets"]), np.asarray(row["nbrs"], dtype=np.int32)
        if len(row["vectors"]) != self.n * row["dim"] or len(offsets) != self.n + 1 or offsets[-1] != len(nbrs) or (self.n and not 0 <= row["start"] < self.n):
            raise ValueError(f"the graph of partition {row['part']} has {self.n} ids, {len(row['vectors'])} numbers, {len(offsets)} offsets and {len(nbrs)} neighbours, which don't go together")
        self.x, self.norms = np.asarray(row["vectors"], dtype=np.float32).reshape(self.n, row["dim"]), np.asarray(row["norms"], dtype=np.float32)
        self.near, self.start, self.codes = padded(offsets, nbrs), int(row["start"]), row["codes"]
        self.medoids = {} if row["labels"] is None else dict(zip(map(int, row["label_ids"]), map(int, row["label_medoids"]), strict=True))
        self.labels, self.label_offsets = (None, None) if row["labels"] is None else (np.asarray(row["labels"]), np.asarray(row["label_offsets"]))
        self.live = np.ones(self.n, dtype=bool)
        if row.get("dead") is not None:
            self.live &= ~np.isin(self.ids, row["dead"])
        if "allowed" in row:
            self.live &= np.isin(self.ids, row["allowed"] if row["allowed"] is not None else [])

    def having(self, labels: set) -> np.ndarray:
        """Which nodes have one of the labels."""
        hits = np.isin(self.labels, [x for x in labels if x is not None])
        return np.bincount(np.repeat(np.arange(self.n), np.diff(self.label_offsets))[hits], minlength=self.n) > 0

    def positions(self, ids: list) -> list[int]:
        """Where those of the ids are that the partition has."""
        by = np.argsort(self.ids)
        at = np.searchsorted(self.ids[by], ids)
        return [int(by[i]) for i, x in zip(at.tolist(), ids, strict=True) if i < self.n and self.ids[by[i]] == x]

    def search(self, queries: np.ndarray, starts: list[list[int]], params: SearchParams, metric: str, book: Quantiser | None, allowed: np.ndarray | None = None) -> Found:
        if book is None:
            score = by_norms(metric, queries.astype(np.float32), self.x, self.norms)
        else:
            codes, asked = book.stored(self.codes, self.n) if self.codes is not None else book.encode(self.x), book.prepare(queries)
            score = lambda rows, at: book.pairs(asked, rows, codes[at])
        return search_block(self.near, score, starts, params.length, params.beam, params.limit, None if self.live.all() else self.live, allowed, params.widen, params.patience)

    def holds_all(self, params: SearchParams) -> bool:
        """Whether a pool has room for every row, so that it ends with all that can be reached, whatever the order."""
        return params.length >= self.n and params.limit is None and not params.patience and params.mode in ("full", "expanded")

    def reach(self, starts: list[int], allowed: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """Which nodes a search from starts can come to, and in how many rounds."""
        front = np.array(sorted(set(starts)), dtype=np.int64)
        seen, rounds = np.zeros(self.n, dtype=bool), 0
        seen[front] = True
        while len(front):
            new = self.near[front].ravel()
            new = new[new >= 0]
            new = new[~seen[new]] if allowed is None else new[~seen[new] & allowed[new]]
            seen[new], front, rounds = True, np.unique(new), rounds + 1
        return seen, rounds

    def nearest(self, queries: np.ndarray, metric: str, k: int, among: np.ndarray, nodes: np.ndarray | None = None, dists: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the nodes `among` by exact distances, as (nodes, distances), -1 and infinity where there are fewer. nodes, dists: some
        that are known already, nearest first; products of vectors select what can be nearer, with a margin for rounding."""
        m, at = len(queries), np.flatnonzero(among)
        best, d = np.full((m, k), -1, dtype=np.int64), np.full((m, k), np.inf)
        if nodes is not None:
            own = min(k, nodes.shape[1])
            best[:, :own], d[:, :own] = nodes[:, :own], dists[:, :own]
        for a in range(0, len(at), AT_ONCE):
            own = at[a : a + AT_ONCE]
            near, margin = approximate(metric, queries, self.x[own].astype(np.float64))
            margin = margin.max()
            limit = d[:, -1] + margin
            wide = ~np.isfinite(limit)
            if wide.any() and len(own) > k:
                limit[wide] = np.partition(near[wide], k - 1, axis=1)[:, k - 1] + 2 * margin
            rows, cols = np.nonzero(near <= limit[:, None])
            if nodes is not None and len(rows):
                new = ~(best[rows] == own[cols][:, None]).any(axis=1)
                rows, cols = rows[new], cols[new]
            if not len(rows):
                continue
            each = np.bincount(rows, minlength=m)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each)
            more, more_d = np.full((m, int(each.max())), -1, dtype=np.int64), np.full((m, int(each.max())), np.inf)
            more[rows, place] = own[cols]
            more_d[rows, place] = exact(metric, queries[rows], self.x[own[cols]].astype(np.float64))
            best, d = np.hstack([best, more]), np.hstack([d, more_d])
            by = np.lexsort((self.ids[best], d), axis=-1)[:, :k]
            best, d = np.take_along_axis(best, by, axis=1), np.take_along_axis(d, by, axis=1)
        return best, d

    def within(self, queries: np.ndarray, radius: float, least: int, most: int | None) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, node, distance) of nodes within a radius: what a pool of `least` leads to through nodes within and about it, by bounded pieces."""
        m, score = len(queries), by_norms("l2", queries.astype(np.float32), self.x, self.norms)
        found = search_block(self.near, score, [[self.start]] * m, least)
        rows, cols = np.nonzero(found.nodes >= 0)
        nodes, d = found.nodes[rows, cols], found.dists[rows, cols]
        # As with a pool twice as long as what lies within: nodes are expanded as far out as twice as many lie, by a sample of the nodes.
        sample = np.random.default_rng(self.part).choice(self.n, size=min(self.n, SAMPLE), replace=False)
        far = np.sort(score(np.repeat(np.arange(m), len(sample)), np.tile(sample, m)).reshape(m, -1), axis=1)
        near = np.full(m, radius + ROUNDING * (1 + radius))
        near = np.maximum(near, far[np.arange(m), np.minimum(2 * (far <= near[:, None]).sum(axis=1) + LEAST, len(sample) - 1)])
        marks, held = np.zeros(m * self.n, dtype=np.int32), []
        marks[rows * self.n + nodes] = 1
        while len(rows):
            rows, nodes = rows[d <= near[rows]], nodes[d <= near[rows]]
            held.append((rows, nodes))
            fresh = []
            for a in range(0, len(rows), AT_ONCE):
                reach = self.near[nodes[a : a + AT_ONCE]]
                key = np.repeat(rows[a : a + AT_ONCE], (reach >= 0).sum(axis=1)) * self.n + reach[reach >= 0]
                key = key[marks[key] == 0]
                order = np.arange(1, len(key) + 1, dtype=np.int32)
                marks[key] = order
                key = key[marks[key] == order]  # of the same pair twice the last stays
                d = score(key // self.n, key % self.n)
                close = d <= near[key // self.n]
                fresh.append((key[close], d[close]))
            key, d = (np.concatenate([f[i] for f in fresh] or [np.zeros(0, dtype=np.int64)]) for i in range(2))
            rows, nodes = key // self.n, key % self.n
        rows, nodes = (np.concatenate([h[i] for h in held] or [np.zeros(0, dtype=np.int64)]) for i in range(2))
        by = np.argsort(rows, kind="stable")
        rows, nodes = rows[by], nodes[by]
        ok = self.live[nodes]
        rows, nodes = rows[ok], nodes[ok]
        d = np.concatenate([exact("l2", queries[rows[a : a + PAIRS]], self.x[nodes[a : a + PAIRS]].astype(np.float64)) for a in range(0, len(rows), PAIRS)] or [np.zeros(0)])
        rows, nodes, d = rows[d <= radius], nodes[d <= radius], d[d <= radius]
        if most is not None:
            by = np.lexsort((self.ids[nodes], d, rows))
            rows, nodes, d = rows[by], nodes[by], d[by]
            first = np.searchsorted(rows, rows)
            keep = np.arange(len(rows)) - first < most
            rows, nodes, d = rows[keep], nodes[keep], d[keep]
        for a in range(0, len(rows), PAIRS):
            yield rows[a : a + PAIRS], nodes[a : a + PAIRS], d[a : a + PAIRS]

    def all_reached(self, queries: np.ndarray, starts: list[list[int]], params: SearchParams, metric: str, allowed: np.ndarray | None = None) -> Iterator[tuple]:
        """What search() and refined() give where a pool holds every row: (queries' places, number reached, rounds, (query, node, distance)) by
        set of nodes that can be reached. Without labels the partition's own start is among the starts."""
        own = [] if allowed is not None else [self.start]
        whole, rounds = self.reach(own, allowed)
        groups: dict = {}
        for r, first in enumerate(starts):
            groups.setdefault(() if own and whole.all() else tuple(sorted({*first, *own})), []).append(r)
        for first, at in groups.items():
            seen, levels = self.reach(list(first), allowed) if first else (whole, rounds)
            at = np.array(at)
            yield at, int(seen.sum()), levels, self.nearest(queries[at], metric, min(params.k, self.n), seen & self.live)

    def checked(self, queries: np.ndarray, metric: str, k: int, result: tuple[np.ndarray, ...], allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """refined() with what the search has missed, as products of the queries with all rows tell; the last columns are how many those are, and which."""
        rows, nodes, d, fine, n = result
        m, here = len(queries), self.live if allowed is None else self.live & allowed
        each = np.bincount(rows, minlength=m)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each)
        known, known_d = np.full((m, k), -1, dtype=np.int64), np.full((m, k), np.inf)
        known[rows, place] = nodes
        known_d[rows, place] = exact(metric, queries[rows], self.x[nodes].astype(np.float64)) if len(rows) else 0
        by = np.lexsort((self.ids[known], known_d), axis=-1)
        known, known_d = np.take_along_axis(known, by, axis=1), np.take_along_axis(known_d, by, axis=1)
        best, best_d = self.nearest(queries, metric, k, here, known, known_d)
        rows, cols = np.nonzero(best >= 0)
        added = np.array([~np.isin(b, a) for a, b in zip(known, best, strict=True)], dtype=bool).reshape(best.shape)
        missed = (added & (best >= 0)).sum(axis=1)
        worked = np.zeros(m, dtype=np.int64)
        worked[result[0]] = n
        return rows, best[rows, cols], best_d[rows, cols], np.ones(len(rows), dtype=bool), worked[rows], missed[rows], added[rows, cols]

    def refined(self, queries: np.ndarray, found: Found, params: SearchParams, metric: str) -> tuple[np.ndarray, ...]:
        """(query, node, distance, refined, number refined) of each query's k best."""
        nodes, m = found.nodes, len(queries)
        if params.mode == "expanded":
            own = [at[self.live[at]] for at, _ in found.expanded_of(m)]
            nodes = np.full((m, max(map(len, own), default=0)), -1, dtype=np.int64)
            for r, at in enumerate(own):
                nodes[r, : len(at)] = at
        if params.mode in ("full", "expanded"):
            n = (nodes >= 0).sum(axis=1)
            best, d = refine_all(metric, queries, self.x.astype(np.float64) if self.n * self.x.shape[1] < WIDE else self.x, nodes, params.k)
            rows, cols = np.nonzero(best >= 0)
            return rows, best[rows, cols], d[rows, cols], np.ones(len(rows), dtype=bool), n[rows]
        out = []
        for r in range(m):
            there = nodes[r] >= 0
            pool = list(zip(found.dists[r][there].tolist(), nodes[r][there].tolist(), strict=True))
            best, n = refine(queries[r], pool, lambda at: self.x[at].astype(np.float64), params.k, params.mode, params.batch, params.streak, params.count, params.ratio, lambda q, x: exact(metric, q[None], x))
            out += [(r, i, d, fine, n) for d, i, fine in best]
        return tuple(np.array(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, float, bool, np.int64))


#: Queries that a task asks of a partition, at least, and the most blocks of queries, each of which reads the partitions in tasks of its own.
ASKED, BLOCKS = 1024, 32


def dealt(queries: DataFrame, id_col: str, vec_col: str, more: list[str]) -> Iterator[tuple]:
    """query_blocks() of as many queries as one task asks of a partition."""
    return query_blocks(queries, id_col, vec_col, more, max(ASKED, -(-queries.count() // BLOCKS)))


#: Rows of a partition that are compared with a block of queries at once.
AT_ONCE = 8192
#: Pairs whose exact distances are computed at once, and what single precision may add to a distance.
PAIRS, ROUNDING = 1 << 16, 1e-5
#: Nodes by which a range search sees how far out twice as many nodes lie, and of how many more at least.
SAMPLE, LEAST = 1024, 8
#: Numbers of a partition up to which its vectors are held in double precision as well, for exact distances.
WIDE = 1 << 24


def search_partitions(queries: DataFrame, local: DataFrame, params: SearchParams, book: Quantiser | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None, universal: int | None = None,
                      metric: str = "l2", routes: str | None = None) -> DataFrame:
    """(qid, id, dist, rank, ...) with each partition's work. local: plans.build.local_graphs(). book: rank by its codes, those stored
    with the graphs if they are; None: exactly. metric: the one that the graphs were built for; codes need l2.

    label_col: only rows with the query's label, or the universal one, in graphs built with labels; the
    search starts at the label's own medoid and visits no other rows. A label of no row is an error.
    local may have columns dead and allowed (array<bigint>, or null; see with_ids()): ids that are travelled through but not found,
    and the only ones that are found.
    routes: a column of the queries, array<struct<part, ids>>: the partitions to ask, and rows to start at there (see plans.routing).
    """
    if book is not None and metric != "l2":
        raise ValueError(f"codes rank by l2, not by {metric}")
    spark, out = queries.sparkSession, None
    if label_col:
        known_labels(local, queries, label_col, universal)
    carried = [c for c in (label_col, routes) if c]
    for ids, vectors, more in dealt(queries, id_col, vec_col, carried):
        wanted = [m[0] for m in more] if label_col else [None] * len(ids)
        begin = [{r["part"]: r["ids"] for r in m[-1]} for m in more] if routes else None
        sent = spark.sparkContext.broadcast((ids, vectors, wanted, begin))

        def run(batches, sent=sent):
            ids, qs, wanted, begin = sent.value
            for row in rows_of(batches):
                g = Searchable(row)
                entries = [g.start, *np.random.default_rng(g.part).integers(g.n, size=params.entries).tolist()] if g.n else []
                groups: dict = {}  # queries of one label go together, with the nodes that they may travel
                for i, label in enumerate(wanted):
                    if begin is None or g.part in begin[i]:
                        groups.setdefault(label if label_col else None, []).append(i)
                for label, at in groups.items():
                    starts = [g.medoids[x] for x in (label, universal) if x in g.medoids] if label_col else entries
                    if not starts or not g.n:
                        continue
                    allowed = g.having({label, universal}) if label_col else None
                    at = np.array(at)
                    for part in blocks(len(at), g.n):
                        own = at[part]
                        first = [starts if begin is None else g.positions(begin[i][g.part]) or starts for i in own]
                        if g.holds_all(params):
                            for some, seen, rounds, (best, d) in g.all_reached(qs[own], first, params, metric, allowed):
                                rows, cols = np.nonzero(best >= 0)
                                yield pd.DataFrame({"qid": ids[own[some]][rows], "id": g.ids[best[rows, cols]], "dist": d[rows, cols], "refined": True, "expanded": seen, "rounds": rounds, "comparisons": seen, "n_refined": seen, "reached": seen, "missed": 0, "added": False})
                            continue
                        found = g.search(qs[own], first, params, metric, book, allowed)
                        rows, nodes, d, fine, n = g.refined(qs[own], found, params, metric)
                        missed, added = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=bool)
                        if params.check:
                            rows, nodes, d, fine, n, missed, added = g.checked(qs[own], metric, params.k, (rows, nodes, d, fine, n), allowed)
                        reached = (found.nodes >= 0).sum(axis=1)
                        yield pd.DataFrame({"qid": ids[own][rows], "id": g.ids[nodes], "dist": d, "refined": fine, "expanded": found.expanded[rows], "rounds": found.rounds[rows], "comparisons": found.comparisons[rows], "n_refined": n, "reached": reached[rows], "missed": missed, "added": added})

        part = local.mapInPandas(run, RESULT)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], RESULT)
    return merge_top_k(out, params.k)


def nearest_entry(local: DataFrame, queries: DataFrame, nearest: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, part): for each query the partitions with the nearest means, where a search may begin or end."""
    from orrery.operators.knn import knn

    means = local.select(F.col("part").alias(id_col), F.col("mean").alias(vec_col))
    return knn(queries, means, nearest, id_col=id_col, vec_col=vec_col).select("qid", F.col("id").alias("part"), "rank")


def post_filtered(queries: DataFrame, local: DataFrame, rows: DataFrame, predicate: Column, params: SearchParams, row_id: str = "vec_id", **search) -> DataFrame:
    """(qid, id, dist, rank): of the `length` best of each query those whose rows meet the predicate, k at most. Fewer, if fewer of them do.

    Where all rows are among the `length` best, partitions leave out those that don't meet the predicate, and no list of all rows moves.
    """
    from dataclasses import replace

    if params.length >= local.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]:
        return filtered_search(queries, local, rows, predicate, params, row_id, **search)
    wide = search_partitions(queries, local, replace(params, k=params.length), **search).drop("rank")
    kept = wide.join(rows.filter(predicate).select(F.col(row_id).alias("id")), "id", "left_semi")
    return merge_top_k(kept.select("qid", "id", "dist"), params.k)


def filtered_search(queries: DataFrame, local: DataFrame, rows: DataFrame, predicate: Column, params: SearchParams, row_id: str = "vec_id", **search) -> DataFrame:
    """(qid, id, dist, rank): the best rows that meet the predicate; the search goes on until `length` of them are found."""
    allowed = rows.filter(predicate).select(F.col(row_id).alias("id"))
    return search_partitions(queries, with_ids(local, allowed, "allowed"), params, **search).select("qid", "id", "dist", "rank")


def visit_counts(queries: DataFrame, local: DataFrame, params: SearchParams, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, visits): how often searches of the queries expand each node, for choosing what to keep in memory."""
    spark, out = queries.sparkSession, None
    for _, vectors, _ in dealt(queries, id_col, vec_col, []):
        sent = spark.sparkContext.broadcast(vectors)

        def run(batches, sent=sent):
            for row in rows_of(batches):
                g, visits = Searchable(row), np.zeros(len(row["ids"]), dtype=np.int64)
                for at in blocks(len(sent.value), g.n) if g.n else ():
                    own = sent.value[at]
                    for _, nodes, _ in g.search(own, [[g.start]] * len(own), params, "l2", None).trail:
                        np.add.at(visits, nodes, 1)
                at = np.flatnonzero(visits)
                yield pd.DataFrame({"id": g.ids[at], "visits": visits[at]})

        part = local.mapInPandas(run, "id bigint, visits bigint")
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], "id bigint, visits bigint") if out is None else out
    return out.groupBy("id").agg(F.sum("visits").alias("visits"))


def range_search(queries: DataFrame, local: DataFrame, radius: float, least: int = 16, most: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, id, dist) within a radius, from the graphs: a search with a pool of `least`, from which all nodes within are expanded until no more come.

    most: the nearest of each partition, no more than that.
    """
    spark, out = queries.sparkSession, None
    for ids, vectors, _ in dealt(queries, id_col, vec_col, []):
        sent = spark.sparkContext.broadcast((ids, vectors))

        def run(batches, sent=sent):
            ids, qs = sent.value
            for row in rows_of(batches):
                g = Searchable(row)
                for at in blocks(len(ids), g.n) if g.n else ():
                    for rows, nodes, d in g.within(qs[at], radius, least, most):
                        yield pd.DataFrame({"qid": ids[at][rows], "id": g.ids[nodes], "dist": d})

        part = local.mapInPandas(run, "qid bigint, id bigint, dist double")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "qid bigint, id bigint, dist double") if out is None else out


def query_stats(queries: DataFrame, local: DataFrame, truth: DataFrame, lengths: list[int], k: int, book: Quantiser | None = None, beam: int = 8, check: bool = False) -> DataFrame:
    """A row for each pool length and query: its work over all partitions, how many it found and its recall (without and with ties).

    check: an exact check follows the searches, and recall is that of both together; graph_recall is always that of the searches alone.
    """
    out = None
    for length in lengths:
        got = search_partitions(queries, local, SearchParams(k=k, length=length, beam=beam, check=check), book)
        hits = got.join(truth.filter(F.col("rank") <= k).select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.count_if(~F.col("added")).alias("own"))
        ties = recall_with_ties(truth, got, k).select("qid", F.col("recall").alias("recall_with_ties"))
        per = got.groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.min("dist").alias("best"), F.max("dist").alias("worst"), *[F.sum(c).alias(c) for c in ("expanded", "comparisons", "rounds", "n_refined")])
        row = per.join(hits, "qid", "left").join(ties, "qid", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("recall", F.col("hits") / k).withColumn("graph_recall", F.coalesce("own", F.lit(0)) / k).withColumn("length", F.lit(length))
        out = row if out is None else out.unionByName(row)
    return out.select("length", "qid", "found", "hits", "recall", "graph_recall", "recall_with_ties", "best", "worst", "expanded", "comparisons", "rounds", "n_refined")


def sweep(queries: DataFrame, local: DataFrame, truth: DataFrame, lengths: list[int], k: int, book: Quantiser | None = None, beam: int = 8, check: bool = False) -> DataFrame:
    """A row for each pool length: queries, recall at k (with a check, of search and check together; graph_recall: of the searches alone), and the work of a query: mean, median, 99 and 99.9 % (no interpolation)."""
    per = query_stats(queries, local, truth, lengths, k, book, beam, check)
    at = lambda c, p: F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count(F.lit(1)) * p) + 1).cast("int"))
    work = [f for c in ("expanded", "comparisons", "rounds", "n_refined") for f in (F.avg(c).alias(f"mean_{c}"), at(c, 0.5).alias(f"median_{c}"), at(c, 0.99).alias(f"p99_{c}"), at(c, 0.999).alias(f"p999_{c}"))]
    return per.groupBy("length").agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"), F.avg("graph_recall").alias("graph_recall"), F.avg("recall_with_ties").alias("recall_with_ties"), F.avg("found").alias("mean_found"), *work)
