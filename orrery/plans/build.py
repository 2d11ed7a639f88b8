"""Building a proximity graph under a memory budget.

Partitions of contiguous ids get a graph each; every row then searches the
graphs of other partitions for neighbours there; both kinds of edges are the
candidates of two prunings with the reverse edges added between them. A task
holds two partitions at most, so a partition's size, and with it memory, is set
by the budget (partitioning.least_partitions), whatever the number of rows.
Beyond NEAR + 1 partitions each one meets the NEAR partitions of the nearest
means, so the work grows with the partitions, not with their square. Each arrow
is a written table, and a table that is there already is not built again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators.batch import METRICS, blocks, by_norms, padded, search_block, shaped
from orrery.operators.kernels import PRUNED, Vamana, medoid, prune_many, robust_prune, table
from orrery.operators.knn import knn
from orrery.operators.partitioning import all_pairs, contiguous, least_partitions
from orrery.operators.quantise import Quantiser
from orrery.storage import stored

NEAR = 16


@dataclass(frozen=True)
class BuildParams:
    """partitions: how many; None: the fewest of which two fit `memory` bytes. near: how many others each meets, if there are more.

    metric: other than l2, graphs are built on unit vectors (cosine) or on vectors lifted to one norm (inner_product), each
    partition's own; what they hold are the vectors as they came.
    """

    partitions: int | None = None
    degree: int = 32
    length: int = 64
    alpha: float = 1.0
    occlusions: int = 1
    memory: float = 1e9
    near: int = NEAR
    saturate: bool = False
    metric: str = "l2"

    def __post_init__(self):
        for name in ("partitions", "degree", "length", "occlusions", "memory", "near"):
            value = getattr(self, name)
            if value is None and name == "partitions":
                continue
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 1:
                raise ValueError(f"{name} must be positive")
        if self.alpha < 1:
            raise ValueError("alpha must be at least 1")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}, not {self.metric!r}")

    def count(self, n: int, dim: int) -> int:
        """The number of partitions for n rows."""
        return max(1, min(self.partitions or least_partitions(max(n, 1), dim, self.memory, self.degree), max(n, 1)))


#: A partition's graph as a row: vectors and neighbours are flat, with offsets; neighbours and medoids are positions in ids.
GRAPHS = ("part bigint, ids array<bigint>, dim int, vectors array<float>, offsets array<int>, nbrs array<int>, start int, "
          "labels array<int>, label_offsets array<int>, label_ids array<int>, label_medoids array<int>, codes binary, norms array<float>, mean array<double>")
GRAPH_COLUMNS = [c.split()[0] for c in GRAPHS.split(", ")]


def partitioned(vectors: DataFrame, params: BuildParams, id_col: str = "vec_id", vec_col: str = "embedding", labels: str | None = None) -> DataFrame:
    """(id, vec, part), and labels (array<int>) if the rows have them."""
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), contiguous(id_col, n, params.count(n, dim or 1)).alias("part"), *([F.col(labels).alias("labels")] if labels else []))


def label_medoids(g: Vamana) -> dict[int, int]:
    """For each label, the row that has it and is nearest to the mean of those that do."""
    members: dict[int, list[int]] = {}
    for i, own in enumerate(g.labels):
        for label in own:
            members.setdefault(label, []).append(i)
    return {label: rows[medoid(g.x[rows])] for label, rows in members.items()}


def as_row(part: int, ids: np.ndarray, g: Vamana, book: Quantiser | None = None) -> pd.DataFrame:
    """A graph as one row of GRAPHS. norms: squared, of the vectors."""
    x = np.asarray(g.raw, dtype=np.float32)
    cut = lambda lists: np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = lambda lists: np.array([i for x in lists for i in x], dtype=np.int32)
    own = [sorted(x) for x in g.labels] if g.labels is not None else None
    found = label_medoids(g) if own is not None else {}
    row = {
        "part": part, "ids": ids.astype(np.int64), "dim": x.shape[1], "vectors": x.ravel(), "offsets": cut(g.nbrs), "nbrs": flat(g.nbrs), "start": g.start,
        "labels": None if own is None else flat(own), "label_offsets": None if own is None else cut(own),
        "label_ids": None if own is None else np.array(list(found), dtype=np.int32), "label_medoids": None if own is None else np.array(list(found.values()), dtype=np.int32),
        "codes": None if book is None else book.encode(g.raw).tobytes(), "norms": (x * x).sum(axis=1), "mean": g.raw.mean(axis=0) if len(x) else np.zeros(x.shape[1]),
    }
    return pd.DataFrame({k: pd.Series([v], dtype=object) if isinstance(v, np.ndarray) or v is None else [v] for k, v in row.items()})


def opened(row, params: BuildParams | None = None, lists: bool = True) -> tuple[np.ndarray, Vamana]:
    """The ids and the graph of a row of GRAPHS, checked for consistent sizes. lists: with its neighbours, as lists of Python's numbers."""
    params = params or BuildParams()
    ids, offsets, n = np.asarray(row["ids"], dtype=np.int64), np.asarray(row["offsets"]), len(row["ids"])
    if len(row["vectors"]) != n * row["dim"] or len(offsets) != n + 1 or offsets[-1] != len(row["nbrs"]) or (n and not 0 <= row["start"] < n):
        raise ValueError(f"the graph of partition {row['part']} has {n} ids, {len(row['vectors'])} numbers, {len(offsets)} offsets and {len(row['nbrs'])} neighbours, which don't go together")
    g = Vamana(np.zeros((0, row["dim"])), params.degree, params.length, params.alpha, saturate=params.saturate)
    g.raw = np.asarray(row["vectors"], dtype=np.float64).reshape(n, -1) if n else g.x
    g.x = shaped(g.raw, params.metric)
    g.nbrs = [x.tolist() for x in np.split(np.asarray(row["nbrs"], dtype=np.int64), offsets[1:-1])] if n and lists else []
    g.start = int(row["start"])
    if row["labels"] is not None:
        g.labels = [set(x.tolist()) for x in np.split(np.asarray(row["labels"], dtype=np.int64), np.asarray(row["label_offsets"])[1:-1])] if n else []
        g.entries = dict(zip(map(int, row["label_ids"]), map(int, row["label_medoids"]), strict=True))
    return ids, g


def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        yield from pdf.to_dict("records")


def local_graphs(parts: DataFrame, params: BuildParams, book: Quantiser | None = None, by_codes: bool = False, keep: bool = True) -> DataFrame:
    """GRAPHS of parts (id, vec, part, maybe labels). With labels, no node hides another's label while pruning. book: codes are stored with the graph;
    by_codes: and searches while building rank by them. keep: they are written."""
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        labels = [set(map(int, x)) for x in pdf["labels"]] if "labels" in pdf else None
        x = np.stack(pdf["vec"]).astype(np.float64)
        g = Vamana(shaped(x, params.metric), params.degree, params.length, params.alpha, saturate=params.saturate, labels=labels, book=book if by_codes else None).build()
        g.raw = x
        return as_row(key[0], pdf["id"].to_numpy(), g, book)

    graphs = parts.groupBy("part").applyInPandas(build, GRAPHS)
    return stored(graphs, "local-graphs") if keep else graphs


def with_codes(local: DataFrame, book: Quantiser) -> DataFrame:
    """The same graphs with a book's codes, which they don't depend on."""
    def code(batches):
        for row in rows_of(batches):
            yield pd.DataFrame({"part": [row["part"]], "codes": [book.encode(np.asarray(row["vectors"], dtype=np.float64).reshape(len(row["ids"]), -1)).tobytes()]})

    return stored(local.drop("codes").join(local.mapInPandas(code, "part bigint, codes binary"), "part").select(*GRAPH_COLUMNS), "coded-graphs")


EDGES = "src bigint, dst bigint"


def own_edges(local: DataFrame, params: BuildParams) -> DataFrame:
    """The edges within partitions, under global ids."""
    def dump(batches):
        for row in rows_of(batches):
            ids, g = opened(row, params)
            yield pd.DataFrame([(int(ids[p]), int(ids[v])) for p, own in enumerate(g.nbrs) for v in own if v != p], columns=["src", "dst"])

    return local.mapInPandas(dump, EDGES)


def near_pairs(local: DataFrame, near: int) -> DataFrame:
    """(i, j), i < j: each partition with the `near` others of the nearest means."""
    means = local.select(F.col("part").alias("vec_id"), F.col("mean").alias("embedding"))
    met = knn(means, means, near, without_self=True)
    return met.select(F.least("qid", "id").alias("i"), F.greatest("qid", "id").alias("j")).distinct()


#: Rows of one partition that search another's graph at once, and how many nodes their searches expand at a time.
PROBED, BEAM = 256, 4
#: Candidates of rows whose edges are chosen together are at most so many for each other: a row with more is looked at by itself.
WIDEST = 2048
#: Rows of a partition that are compared with a block of rows at once.
COMPARED = 8192


def nearest_of(queries: np.ndarray, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """For each query the nearest row of x, which is compared a piece at a time."""
    best, at = np.full(len(queries), np.inf, dtype=np.float32), np.zeros(len(queries), dtype=np.int64)
    for a in range(0, len(x), COMPARED):
        d = norms[a : a + COMPARED] - 2 * (queries @ x[a : a + COMPARED].T)
        own = d.argmin(axis=1)
        least = d[np.arange(len(queries)), own]
        at, best = np.where(least < best, own + a, at), np.minimum(least, best)
    return at


def across(chosen: np.ndarray, met: np.ndarray, own: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of what is chosen among the first n nodes; a row whose own partition hides all that it met there has the nearest of them."""
    there = (chosen >= 0) & (chosen < n)
    rows, cols = np.nonzero(there)
    none = np.flatnonzero(~there.any(axis=1) & (met >= 0).any(axis=1))
    d = np.where(met[none] >= 0, ((x[met[none]] - x[own[none]][:, None]) ** 2).sum(axis=2), np.inf)
    return np.append(rows, none), np.append(chosen[rows, cols], met[none, d.argmin(axis=1)] if len(none) else []).astype(np.int64)


def cross_edges(local: DataFrame, pairs: DataFrame, params: BuildParams, check: bool = False) -> DataFrame:
    """Edges between the partitions of each pair (i, j): rows of one search the other's graph, both ways, each way in a task of its own.

    A row's edges are then chosen again among those that its own search has led to and the rows whose searches have led to it: what one of
    two rows misses, the other mostly finds. check: a row's nearest of all rows of the other partition, by products in single precision, is
    among them too; all rows are compared for it, so the work grows with the square of a partition.
    """
    if params.metric == "inner_product":
        raise ValueError("partitions are lifted each by its own; lift the vectors before they are dealt (functions.vectors)")
    side = lambda at, name: local.select(F.col("part").alias(at), *[F.col(c).alias(f"{name}_{c}") for c in GRAPH_COLUMNS])
    ways = pairs.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("w")).select("w.*").distinct()
    order = {(r.i, r.j): n for n, r in enumerate(ways.orderBy("i", "j").collect())}  # a few for each partition
    ways = local.sparkSession.createDataFrame([(i, j, n) for (i, j), n in order.items()], "i bigint, j bigint, way int")
    both = ways.join(side("i", "x"), "i").join(side("j", "y"), "j")
    dealt = lambda rows: rows.repartitionByRange(max(1, min(len(order), 1 << 12)), "way")
    near_of = lambda row, name: padded(np.asarray(row[f"{name}_offsets"]), np.asarray(row[f"{name}_nbrs"], dtype=np.int32))

    def pair(row: dict) -> tuple:
        """Ids of both, the other's start, all vectors (the other's first), and the neighbours of the one's rows; nothing is held twice."""
        (ids, g), (others, h) = (opened({c: row[f"{name}_{c}"] for c in GRAPH_COLUMNS}, params, lists=False) for name in ("x", "y"))
        return ids, others, h.start, np.vstack([h.x, g.x]), near_of(row, "x").astype(np.int64)

    def probe(batches):
        for row in rows_of(batches):
            ids, others, start, x, own_near = pair(row)
            n = len(others)
            if not n or not len(ids):
                continue
            near, small = near_of(row, "y"), x[:n].astype(np.float32)
            norms = (small * small).sum(axis=1)
            for at in range(0, len(ids), PROBED):
                own = np.arange(at, min(at + PROBED, len(ids)))
                led = []
                for part in blocks(len(own), n):
                    mine = own[part]
                    found = search_block(near, by_norms("l2", x[mine + n].astype(np.float32), small, norms), [[start]] * len(mine), params.length, BEAM)
                    seen = table([nodes.tolist() for nodes, _ in found.expanded_of(len(mine))])[0].astype(np.int64)
                    if check:
                        seen = np.hstack([seen, nearest_of(x[mine + n].astype(np.float32), small, norms)[:, None]])
                    inside = np.where(own_near[mine] < 0, -1, own_near[mine] + n)
                    chosen = prune_many(mine + n, np.hstack([seen, inside]), x, params.degree, 1.0)
                    rows, nodes = across(chosen, seen, mine + n, x, n)
                    led.append(np.stack([mine[rows], nodes]).astype(np.int32))
                met = np.hstack(led).T
                # Under both ways, since either row may choose the other.
                yield pd.DataFrame({"i": [row["i"], row["j"]], "j": [row["j"], row["i"]], "met": [met.tobytes(), met[:, ::-1].tobytes()]})

    def choose(batches):
        for row in rows_of(batches):
            ids, others, _, x, own_near = pair(row)
            n = len(others)
            xs, ys = np.frombuffer(b"".join(row["met"]), dtype=np.int32).reshape(-1, 2).T.astype(np.int64)
            xs, ys = np.divmod(np.unique(xs * n + ys), n)
            each = np.bincount(xs, minlength=len(ids))
            first, todo = np.cumsum(each) - each, np.argsort(each, kind="stable")
            at = int((each == 0).sum())
            while at < len(todo):
                mine = todo[at : at + PRUNED]
                mine = mine[: max(1, int((WIDEST * WIDEST // (each[mine] + own_near.shape[1]) ** 2 >= np.arange(1, len(mine) + 1)).sum()))]
                at, width = at + len(mine), int(each[mine].max())
                places = np.arange(width)
                met = np.where(places < each[mine, None], ys[np.minimum(first[mine, None] + places, len(ys) - 1)], -1)
                lists = np.hstack([met, np.where(own_near[mine] < 0, -1, own_near[mine] + n)])
                if lists.shape[1] > WIDEST:  # one row, which very many others lead to
                    chosen = np.array([robust_prune(int(mine[0]) + n, lists[0][lists[0] >= 0], x, params.degree, 1.0)])
                else:
                    chosen = prune_many(mine + n, lists, x, params.degree, 1.0)
                rows, nodes = across(chosen, met, mine + n, x, n)
                yield pd.DataFrame({"src": ids[mine[rows]], "dst": others[nodes]})

    # Pairs are kept as packed numbers, a row for a block of rows that searched: a row for each pair would be collected as objects.
    led = stored(dealt(both).mapInPandas(probe, "i bigint, j bigint, met binary"), "probed")
    lists = led.groupBy("i", "j").agg(F.collect_list("met").alias("met"))
    return dealt(both.join(lists, ["i", "j"])).mapInPandas(choose, EDGES)


def meeting(local: DataFrame, params: BuildParams) -> DataFrame:
    """The pairs of partitions to probe: all of few, else each with the nearest."""
    n = local.count()
    return all_pairs(local.sparkSession, n) if n <= params.near + 1 else near_pairs(local, params.near)


class Stages:
    """Named tables under one folder: a stage that is complete there is read, not run again. run: only these stages are run."""

    def __init__(self, spark: SparkSession, folder: str | None = None, run: list[str] | None = None):
        self.spark, self.folder, self.run = spark, folder, run

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self.folder is None:
            return stored(make(), name)
        path = f"{self.folder}/{name}"
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            if self.run is not None and name not in self.run:
                raise ValueError(f"stage {name!r} is not complete in {self.folder}, and not among {self.run}")
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


STAGES = ["local-graphs", "candidates", "pruned", "graph"]


def build_graph(vectors: DataFrame, params: BuildParams = BuildParams(), pairs: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", book: Quantiser | None = None, stages: Stages | None = None) -> DataFrame:
    """(src, pos, dst, dist): the final graph. pairs: an allow-list of partitions to probe; book: prune on its codes, which are
    compared in place of vectors; stages: where and which."""
    stages = stages or Stages(vectors.sparkSession)
    local = stages.table("local-graphs", lambda: local_graphs(partitioned(vectors, params, id_col, vec_col), params))
    candidates = stages.table("candidates", lambda: own_edges(local, params).unionByName(cross_edges(local, meeting(local, params) if pairs is None else pairs, params)))
    if book is None:
        prune = lambda edges: G.occlusion_prune(edges, vectors, params.degree, params.occlusions, id_col, vec_col)
    else:
        prune = lambda edges: G.occlusion_prune_codes(edges, vectors, book, params.degree, params.occlusions, id_col, vec_col)
    first = stages.table("pruned", lambda: prune(candidates))
    return stages.table("graph", lambda: G.reached_from_least(prune(G.with_reverse(first.select("src", "dst"))), vectors, params.degree, id_col, vec_col))


def merged_graph(vectors: DataFrame, shards: DataFrame, params: BuildParams, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(src, pos, dst) from graphs of overlapping shards (shards: id, shard), each of two thirds of the degree, merged by node."""
    from dataclasses import replace

    rows = shards.join(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "id").select("id", "vec", F.col("shard").cast("bigint").alias("part"))
    own = replace(params, degree=max(1, 2 * params.degree // 3))
    return stored(G.reached_from_least(G.merge_shards(own_edges(local_graphs(rows, own), own), params.degree), vectors, params.degree, id_col, vec_col), "merged")


def stitched_graph(vectors: DataFrame, labels: DataFrame, params: BuildParams, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A graph for each label over the rows that carry it (labels: id, label), united and pruned.

    A label of more rows than a partition may have is built in several graphs, which the pruning joins by the other labels' edges.
    """
    own = labels.join(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "id").select("id", "vec", "label")
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).collect()  # a row for each label
    parts = {r.label: params.count(r.n, r.dim) if params.partitions is None else 1 for r in sizes}
    cut = F.coalesce(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])[F.col("label")], F.lit(1)) if parts else F.lit(1)
    own = own.withColumn("cut", F.pmod(F.xxhash64("id"), cut))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        g, ids = Vamana(np.stack(pdf["vec"]), params.degree, params.length, params.alpha).build(), pdf["id"].to_numpy()
        return pd.DataFrame([(int(ids[p]), int(ids[v])) for p, n in enumerate(g.nbrs) for v in n], columns=["src", "dst"])

    edges = own.groupBy("label", "cut").applyInPandas(build, EDGES).distinct()
    return stored(G.reached_from_least(G.occlusion_prune(edges, vectors, params.degree, params.occlusions, id_col, vec_col), vectors, params.degree, id_col, vec_col), "stitched")


def label_entries(vectors: DataFrame, labels: DataFrame, id_col: str = "vec_id", seed: int = 0) -> DataFrame:
    """(label, id): a row of each label at which a search for it may begin, chosen by hash. labels: (id, label)."""
    own = labels.join(vectors.select(F.col(id_col).alias("id")), "id", "left_semi")
    return own.groupBy("label").agg(F.min_by("id", F.struct(F.md5(F.concat_ws(":", F.lit(seed), "label", "id")), "id")).alias("id"))


def check_fields(params: BuildParams, text: str) -> BuildParams:
    """The parameters that a JSON text has, which must be known ones."""
    given, known = json.loads(text), {f.name for f in fields(params)}
    if set(given) - known:
        raise ValueError(f"unknown parameters {sorted(set(given) - known)}")
    return BuildParams(**given)
