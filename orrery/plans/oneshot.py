"""From rows to a checked index in one call: overlapping shards under a memory budget, a graph of each, one merged graph with its entries.

Every stage is a table in one folder; a stage that is complete there is read, not
run again. With labels, no node hides another's label while a shard's graph is
pruned, each shard names an entry for each of its labels, and of a label's
entries that of the shard with most of its rows is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators.partitioning import budget_shards
from orrery.plans.build import BuildParams, Stages, local_graphs, own_edges
from orrery.plans.frontier import graph_search
from orrery.storage import stored

STAGES = ["shards", "shard-graphs", "merged", "medoids", "label-entries"]


@dataclass
class MergedIndex:
    """edges: (src, pos, dst); medoids: (part, id), a shard's start; entries: (label, id, n), n being the label's rows in the entry's shard."""

    vectors: DataFrame
    edges: DataFrame
    medoids: DataFrame
    entries: DataFrame
    id_col: str
    vec_col: str

    def search(self, queries: DataFrame, k: int = 10, length: int = 64) -> DataFrame:
        """(qid, id, dist, rank, ...): from all shards' starts, over the merged graph."""
        return graph_search(queries, self.edges, self.vectors, self.medoids.select("id").distinct(), k, length, id_col=self.id_col, vec_col=self.vec_col)

    def search_label(self, queries: DataFrame, label: int, k: int = 10, length: int = 64, labels: str = "labels") -> DataFrame:
        """The same among the rows of one label, from its entry, through no others."""
        entry = self.entries.filter(F.col("label") == label)
        if entry.isEmpty():
            raise ValueError(f"no row has the label {label}")
        own = stored(self.vectors.filter(F.array_contains(labels, label)).select(F.col(self.id_col).alias("id")), "of-label")
        edges = self.edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return graph_search(queries, edges, self.vectors, entry.select("id"), k, length, id_col=self.id_col, vec_col=self.vec_col)


def merged_index(vectors: DataFrame, params: BuildParams, budget: float, labels: str | None = None, folder: str | None = None, copies: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> MergedIndex:
    """budget: bytes that a shard's graph may take. A shard's lists have two thirds of the degree; the merged lists are cut to it by hash."""
    stages, own = Stages(vectors.sparkSession, folder), replace(params, degree=max(1, 2 * params.degree // 3))
    shards = stages.table("shards", lambda: budget_shards(vectors, budget, copies, own.degree, id_col, vec_col)[0])
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *([F.col(labels).alias("labels")] if labels else []))
    dealt = lambda: shards.select("id", F.col("shard").cast("bigint").alias("part")).join(rows, "id")
    graphs = stages.table("shard-graphs", lambda: local_graphs(dealt(), own, keep=False))
    edges = stages.table("merged", lambda: G.merge_shards(own_edges(graphs, own), params.degree))
    medoids = stages.table("medoids", lambda: graphs.filter(F.size("ids") > 0).select("part", F.get("ids", F.col("start")).alias("id")))

    def entries() -> DataFrame:
        if labels is None:
            return vectors.sparkSession.createDataFrame([], "label int, id bigint, n bigint")
        named = graphs.select("part", "ids", F.explode(F.arrays_zip("label_ids", "label_medoids")).alias("x")).select("part", F.col("x.label_ids").alias("label"), F.get("ids", F.col("x.label_medoids")).alias("id"))
        sizes = graphs.select("part", F.explode("labels").alias("label")).groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))
        return named.join(sizes, ["part", "label"]).groupBy("label").agg(F.max_by(F.struct("id", "n"), F.struct("n", "id")).alias("e")).select("label", "e.id", "e.n")

    found = MergedIndex(vectors, edges, medoids, stages.table("label-entries", entries), id_col, vec_col)
    known = vectors.select(F.col(id_col).alias("src"))
    wrong = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct().join(known, "src", "left_anti")
    largest = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > params.degree or not wrong.isEmpty() or not edges.filter("src = dst").isEmpty():
        raise ValueError(f"the merged graph has lists of {largest}, edges at rows that aren't there, or loops")
    return found
