"""Relational operators on proximity graphs: edges (src, dst) or adjacency (src, nbrs)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.knn import knn, matrix
from orrery.operators.ranking import numbered
from orrery.storage import stored


def edges_of(graph: DataFrame) -> DataFrame:
    """(src, pos, dst) of adjacency lists."""
    return graph.select("src", F.posexplode("nbrs").alias("pos", "dst"))


def adjacency(edges: DataFrame, order: str = "pos") -> DataFrame:
    """(src, nbrs) of edges, in the order of a column."""
    return edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "dst"))), lambda x: x["dst"]).alias("nbrs"))


def valid_edges(edges: DataFrame, n: int) -> DataFrame:
    """Without self loops and ids outside 0..n-1."""
    return edges.filter((F.col("src") != F.col("dst")) & F.col("dst").between(0, n - 1))


def with_reverse(edges: DataFrame) -> DataFrame:
    """Forward and reverse edges as a bag: an edge that goes both ways is there twice."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(both.alias("e")).select("e.*")


def offsets(edges: DataFrame) -> DataFrame:
    """(src, count, start): where each source's edges begin when all are laid out in order of source."""
    counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("count"))
    ranked = numbered(counts, "src", column="number")
    # Prefix sums in two steps: within ranges of sources, then over the ranges.
    from pyspark.sql import Window

    span = 1 << 16
    block = stored(ranked.withColumn("block", F.floor(F.col("number") / span)), "offsets")
    sizes = block.groupBy("block").agg(F.sum("count").alias("size")).orderBy("block").collect()
    first, starts = 0, []
    for r in sizes:
        starts.append((r.block, first))
        first += r["size"]
    begin = edges.sparkSession.createDataFrame(starts, "block bigint, first bigint")
    own = F.sum("count").over(Window.partitionBy("block").orderBy("src").rowsBetween(Window.unboundedPreceding, -1))
    return block.withColumn("own", F.coalesce(own, F.lit(0))).join(F.broadcast(begin), "block").select("src", "count", (F.col("first") + F.col("own")).alias("start"))


def degree_stats(graph: DataFrame) -> DataFrame:
    size = F.size("nbrs").cast("bigint")
    return graph.agg(F.max(size).alias("max_degree"), F.avg(size).alias("avg_degree"), F.min(size).alias("min_degree"), F.count_if(size < 2).alias("n_below_two"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))


def top_in_degree(edges: DataFrame, n: int) -> DataFrame:
    """The n nodes that most edges lead to; ties keep the lower id."""
    return in_degrees(edges).orderBy(F.desc("in_degree"), "dst").limit(n)


def bfs_levels(edges: DataFrame, start: int | list[int], most: int = 32) -> DataFrame:
    """(node, level) of all nodes within so many hops of a start, or of the nearest of several. Each hop is a join and a written table."""
    spark = edges.sparkSession
    starts = [start] if isinstance(start, int) else list(start)
    edges = stored(edges.select("src", "dst").distinct(), "bfs-edges")
    fronts = [spark.createDataFrame([(s, 0) for s in dict.fromkeys(starts)], "node bigint, level int")]
    for level in range(1, most + 1):
        new = fronts[-1].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, fronts)  # each front is written once and read by the later hops
        front = stored(new.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "front")
        if front.isEmpty():
            break
        fronts.append(front)
    return reduce(DataFrame.unionByName, fronts)


#: Rounds in which what is cut off is taken in, and how far a search for its nearest nodes looks.
ROUNDS, TAKERS = 24, 8


def reached_from_least(graph: DataFrame, vectors: DataFrame, degree: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A graph (src, pos, dst, ...) in which every row of vectors can be reached from that of the least id, within the degree.

    The edges by which a search by levels reaches a node first are kept. A node that is cut off is taken in by the nearest of those
    that are reached and whose kept edges leave a place; it stands there in the place of the last edge that isn't kept, if the list is full. What it leads to is then reached too,
    so a round takes in what no other one that is cut off, of a lesser id, leads to.
    """
    graph = stored(graph, "graph-whole")
    with_dist = "dist" in graph.columns
    start = vectors.agg(F.min(id_col)).first()[0]
    if start is None:
        return graph
    levels = stored(bfs_levels(graph, start, most=1 << 10), "graph-levels")
    # One edge for each node but the start: from the least of those a level before it.
    up = graph.select("src", "dst").join(levels.select(F.col("node").alias("src"), F.col("level").alias("from")), "src").join(levels.select(F.col("node").alias("dst"), "level"), "dst").filter("level = from + 1")
    tree = stored(up.groupBy("dst").agg(F.min("src").alias("src")), "graph-tree")
    apart = stored(vectors.select(F.col(id_col).alias("id")).join(levels.select(F.col("node").alias("id")), "id", "left_anti"), "graph-apart")
    for _ in range(ROUNDS):
        if apart.isEmpty():
            return graph
        full = tree.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= degree).select(F.col("src").alias(id_col))
        may = vectors.join(apart.select(F.col("id").alias(id_col)), id_col, "left_anti").join(full, id_col, "left_anti").select(id_col, vec_col)
        # Heads: those that no other node cut off of a lesser id leads to, so that a circle has one too.
        inner = stored(graph.select("src", "dst").join(apart.select(F.col("id").alias("src")), "src", "left_semi").join(apart.select(F.col("id").alias("dst")), "dst", "left_semi"), "graph-inner")
        heads = apart.join(inner.filter("src < dst").select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        heads = stored(heads, "graph-heads")
        asked = vectors.join(heads.select(F.col("id").alias(id_col)), id_col, "left_semi").select(id_col, vec_col)
        near = knn(asked, may, TAKERS, id_col=id_col, vec_col=vec_col)
        # A node takes in one at a time, its nearest; who finds no place waits for the next round.
        offers = near.withColumn("first", F.row_number().over(Window.partitionBy("id").orderBy("dist", "qid"))).filter("first = 1")
        taken = stored(offers.withColumn("best", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))).filter("best = 1").select(F.col("id").alias("src"), F.col("qid").alias("dst"), "dist"), "graph-taken")
        mine = graph.join(taken.select("src"), "src", "left_semi").join(tree.select("src", "dst", F.lit(True).alias("kept")), ["src", "dst"], "left")
        last = F.row_number().over(Window.partitionBy("src").orderBy(F.col("kept").isNotNull(), F.desc("pos")))
        size = F.count(F.lit(1)).over(Window.partitionBy("src"))
        stay = mine.withColumn("__last", last).withColumn("__size", size).filter((F.col("__last") > 1) | (F.col("__size") < degree)).select(graph.columns)
        new = taken.select("src", F.lit(1 << 20).alias("pos"), "dst", *(["dist"] if with_dist else []))
        lists = stay.unionByName(new.select(graph.columns)).withColumn("pos", (F.row_number().over(Window.partitionBy("src").orderBy("pos", "dst")) - 1).cast(graph.schema["pos"].dataType))
        graph = stored(graph.join(taken.select("src"), "src", "left_anti").unionByName(lists.select(graph.columns)), "graph-whole")
        # All that was reached still is, by kept edges, so levels go on from what was taken in, among what was cut off.
        fronts = [taken.select("dst", "src")]
        while not fronts[-1].isEmpty():
            seen = reduce(DataFrame.unionByName, fronts).select("dst")
            new = inner.join(fronts[-1].select(F.col("dst").alias("src")), "src").groupBy("dst").agg(F.min("src").alias("src"))
            fronts.append(stored(new.join(seen, "dst", "left_anti"), "front"))
        new = reduce(DataFrame.unionByName, fronts)
        tree = stored(tree.unionByName(new.select(tree.columns)), "graph-tree")
        apart = stored(apart.join(new.select(F.col("dst").alias("id")), "id", "left_anti"), "graph-apart")
    raise ValueError(f"after {ROUNDS} rounds some nodes can't be reached")


def hybrid_cache(edges: DataFrame, start: int, hops: int, n: int) -> DataFrame:
    """n nodes to keep in memory: those within some hops of the start, level by level, then those of the highest in-degree."""
    near = bfs_levels(edges, start, hops).select("node", F.lit(0).alias("kind"), F.col("level").cast("bigint").alias("order"))
    rest = in_degrees(edges).join(near, F.col("dst") == F.col("node"), "left_anti").select(F.col("dst").alias("node"), F.lit(1).alias("kind"), (-F.col("in_degree")).alias("order"))
    return near.unionByName(rest).orderBy("kind", "order", "node").limit(n).select("node", "kind")


def merge_shards(edges: DataFrame, degree: int) -> DataFrame:
    """(src, pos, dst): the set union of shards' lists, shuffled by hash and cut to a degree."""
    key = F.md5(F.concat_ws(":", "src", "dst"))
    lists = edges.select("src", "dst").distinct().groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct(key.alias("key"), "dst"))), 1, degree).alias("l"))
    return lists.select("src", F.posexplode("l").alias("pos", "x")).select("src", "pos", F.col("x.dst").alias("dst"))


def layout(vectors: DataFrame, graph: DataFrame, medoid: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The index table: each id with its vector and neighbours, in order of id within ranges."""
    joined = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).join(graph.withColumnRenamed("src", "id"), "id", "left")
    return joined.select("id", "vec", F.coalesce("nbrs", F.expr("CAST(array() AS array<bigint>)")).alias("nbrs"), (F.col("id") == medoid).alias("is_entry")).repartitionByRange("id").sortWithinPartitions("id")


def occlusion_prune(candidates: DataFrame, vectors: DataFrame, degree: int, most: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(src, pos, dst, dist) of candidate edges (src, dst): candidates in order of distance, each taken unless that many taken

    ones are at least as near to it as the source is; free places are then filled by distance.
    """
    own = vectors.select(F.col(id_col).alias("dst"), F.col(vec_col).alias("vec"))
    pool = candidates.filter("src <> dst").select("src", "dst").join(own, "dst").groupBy("src").agg(F.collect_list(F.struct("dst", "vec")).alias("pool"))
    pool = pool.join(own.select(F.col("dst").alias("src"), F.col("vec").alias("q")), "src").select("src", "q", "pool")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lists = [], b.column(2)
            if not b.num_rows:
                continue
            members = lists.flatten()
            dst, vecs, qs = members.field(0).to_numpy(zero_copy_only=False), matrix(members.field(1)), matrix(b.column(1))
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for src, q, first, end in zip(b.column(0).to_pylist(), qs, cuts, cuts[1:], strict=False):
                ids, v = dst[first:end], vecs[first:end]
                if len(ids) <= COMPARED:
                    among = all_ordered_l2(v)
                    between = lambda i, taken, among=among: among[i, taken]
                else:
                    between = lambda i, taken, v=v: ordered_l2(v[i], v[taken])
                for pos, (i, d) in enumerate(prune_by_occlusion(ids, ordered_l2(q, v), degree, most, between)):
                    rows.append((src, pos, int(ids[i]), d))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["src", "pos", "dst", "dist"])

    return pool.mapInArrow(run, "src bigint, pos int, dst bigint, dist double")


def occlusion_prune_codes(candidates: DataFrame, vectors: DataFrame, book, degree: int, most: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """occlusion_prune() with symmetric distances of product-quantised codes in place of vectors: both ends of an edge have a code
    of a few bytes, and all distances come from the book's table. dist is the code distance.

    Distances are summed in millionths, so that they are the same in any order of addition.
    """
    from orrery.operators.quantise import encode

    lut = np.rint(book.symmetric() * 1e6).astype(np.int64)  # chunks * centres^2 numbers, which goes with the function
    codes = encode(vectors, book, id_col, vec_col)
    own = codes.select(F.col("id").alias("dst"), "code")
    pool = candidates.filter("src <> dst").select("src", "dst").join(own, "dst").groupBy("src").agg(F.collect_list(F.struct("dst", "code")).alias("pool"))
    pool = pool.join(codes.select(F.col("id").alias("src"), F.col("code").alias("q")), "src").select("src", "q", "pool")
    sent = vectors.sparkSession.sparkContext.broadcast(lut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, rows = sent.value, []
        chunk = np.arange(len(lut))
        for b in batches:
            rows = []
            for src, q, members in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids, c, q = np.array([m["dst"] for m in members]), np.array([m["code"] for m in members], dtype=np.int64), np.array(q, dtype=np.int64)
                between = lambda x, at, c=c: lut[chunk, x, c[at]].sum(axis=-1)
                for pos, (i, d) in enumerate(prune_by_occlusion(ids, between(q, slice(None)), degree, most, lambda i, taken: between(c[i], taken))):
                    rows.append((src, pos, int(ids[i]), d / 1e6))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["src", "pos", "dst", "dist"])

    return pool.mapInArrow(run, "src bigint, pos int, dst bigint, dist double")


def ordered_l2(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v))
    for j in range(v.shape[1]):
        out += (q[j] - v[:, j]) ** 2
    return out


#: Candidates of a node up to which all their distances are computed together.
COMPARED = 512


def all_ordered_l2(v: np.ndarray) -> np.ndarray:
    """ordered_l2() of all pairs of rows."""
    out = np.zeros((len(v), len(v)))
    for j in range(v.shape[1]):
        out += (v[:, j, None] - v[None, :, j]) ** 2
    return out


def prune_by_occlusion(ids: np.ndarray, dist: np.ndarray, degree: int, most: int, between) -> list[tuple[int, float]]:
    """between: distances of one candidate to others, by positions."""
    order = np.lexsort((ids, dist))
    taken: list[int] = []
    for i in order:
        if len(taken) == degree:
            break
        if not taken or np.count_nonzero(between(i, taken) <= dist[i]) < most:
            taken.append(int(i))
    held = set(taken)
    rest = [int(i) for i in order if i not in held]
    return [(i, float(dist[i])) for i in (taken + rest)[:degree]]


def keep_cross(edges: DataFrame, part) -> DataFrame:
    """Edges between partitions; part: from a node's column name its partition."""
    return edges.filter(part("src") != part("dst"))


def checked_graph(graph: DataFrame, n: int, degree: int | None = None) -> dict:
    """What a graph (src, nbrs) should be: n sources, edges to 0..n-1 without self loops, and lists of at most `degree`. Raises otherwise."""
    edges = graph.select("src", F.explode_outer("nbrs").alias("dst"))
    row = edges.agg(F.countDistinct("src").alias("sources"), F.count("dst").alias("edges"), F.count_if(F.col("dst") == F.col("src")).alias("loops"),
                    F.count_if(~F.col("dst").between(0, n - 1) | ~F.col("src").between(0, n - 1)).alias("outside")).first().asDict()
    row["largest"] = graph.agg(F.coalesce(F.max(F.size("nbrs")), F.lit(0))).first()[0]
    if row["sources"] != n or row["loops"] or row["outside"] or (degree is not None and row["largest"] > degree):
        raise ValueError(f"not a graph of {n} nodes and degree {degree}: {row}")
    return row


SECTOR = 4096


def node_bytes(dim: int, degree: int, element_bytes: int = 4) -> int:
    """A node's vector, its number of neighbours and room for all of them."""
    return dim * element_bytes + 4 + 4 * degree


def sectors(laid: DataFrame, dim: int, degree: int, element_bytes: int = 4, sector: int = SECTOR, reorder: bool = False) -> DataFrame:
    """A layout() with the place of each node in a file of sectors: (sector, at), the first sector being the header's. A node over a
    sector's size takes several. reorder: whole vectors lie once more behind the nodes, at (vector_sector, vector_at)."""
    size = node_bytes(dim, degree, element_bytes)
    per, each = sector // size, -(-size // sector)
    if per:
        out = laid.withColumn("sector", 1 + F.floor(F.col("id") / per)).withColumn("at", F.pmod("id", F.lit(per)) * size)
    else:
        out = laid.withColumn("sector", 1 + F.col("id") * each).withColumn("at", F.lit(0).cast("bigint"))
    if reorder:
        n, own = laid.count(), dim * 4
        behind, fit = 1 + (-(-n // per) if per else n * each), max(1, sector // own)
        out = out.withColumn("vector_sector", behind + F.floor(F.col("id") / fit) * max(1, -(-own // sector))).withColumn("vector_at", F.pmod("id", F.lit(fit)) * own)
    return out


def layout_metadata(laid: DataFrame) -> DataFrame:
    """One row about a layout(): n, dim, medoid, largest list, and whether ids are 0..n-1, each once, with vectors of one dimension and one entry."""
    return laid.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).cast("bigint").alias("dim"), F.max(F.when(F.col("is_entry"), F.col("id"))).alias("medoid"), F.max(F.size("nbrs")).cast("bigint").alias("largest"),
        ((F.min("id") == 0) & (F.max("id") == F.count(F.lit(1)) - 1) & (F.countDistinct("id") == F.count(F.lit(1))) & (F.min(F.size("vec")) == F.max(F.size("vec"))) & (F.count_if("is_entry") == 1)).alias("valid"))
