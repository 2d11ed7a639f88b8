"""Routing: a small graph over a sample of all rows says which partitions a query asks, and where it starts there.

The sample is a share of the rows, chosen by hash, and at most MOST rows, so the
graph is built in one task and sent to all, whatever the table's size. A query's
search of it gives the sample's rows nearest to it; their partitions, in the
order in which they are met, are the ones to ask, and the rows are where the
search begins in them. Where fewer partitions are met than should be asked, the
nearest means fill up. Asking all partitions is the exact way: it gives what
search_partitions() without routes gives, but for the starts.

Routing pays where near rows share partitions: by_centres() deals rows to the
nearest of k-means' centres, and cuts what is over a partition's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.batch import blocks, by_norms, search_block
from orrery.operators.partitioning import fixed_sample, kmeans, nearest_centres, random_pivots
from orrery.operators.quantise import Quantiser
from orrery.plans.build import BuildParams, local_graphs
from orrery.plans.search import Searchable, SearchParams, search_partitions
from orrery.storage import stored

SHARE, MOST = 0.01, 16_384
#: The sample's graph, and how many of its rows a query finds.
DEGREE, LENGTH = 24, 64


def by_centres(vectors: DataFrame, partitions: int, rounds: int = 8, most: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0) -> DataFrame:
    """(id, vec, part): rows dealt to the nearest of `partitions` centres. A part of over `most` rows is cut by hash into several, so that no

    graph outgrows its budget.
    """
    centres, _ = kmeans(vectors, random_pivots(vectors, partitions, id_col, vec_col, seed), rounds, vec_col)
    near = nearest_centres(vectors.select(id_col, vec_col), list(enumerate(centres.tolist())), 1, vec_col)
    out = stored(near.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col("nearest")[0]["centre"].alias("part")), "by-centres")
    if most is None:
        return out
    cuts = out.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / most).alias("__cuts"))  # a row for each partition
    at = F.pmod(F.xxhash64("id"), F.col("__cuts"))
    return out.join(F.broadcast(cuts), "part").select("id", "vec", (F.col("part") + at * partitions).alias("part"))


def entry_graph(parts: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """GRAPHS of one row over a sample of parts (id, vec, part); labels: the partition of each of its nodes."""
    rows = parts.count()
    sample = fixed_sample(parts, "id", max(1, min(most, int(np.ceil(share * rows)))))
    sample = stored(sample.select("id", "vec", "part"), "entries")
    plain = local_graphs(sample.withColumn("part", F.lit(0).cast("bigint")), BuildParams(partitions=1, degree=DEGREE, length=LENGTH, alpha=1.2))
    # By place in the graph: at most `most` rows.
    at = plain.select(F.posexplode("ids").alias("__at", "id")).join(sample.select("id", F.col("part").cast("int").alias("p")), "id")
    lists = at.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "p"))), lambda x: x["p"]).alias("__parts"))
    return stored(plain.withColumn("__one", F.lit(1)).join(lists.withColumn("__one", F.lit(1)), "__one").withColumn("labels", F.col("__parts")).drop("__parts", "__one"), "entry-graph")


ROUTED = "array<struct<part:bigint,ids:array<bigint>>>"


def routes(queries: DataFrame, entry: DataFrame, means: DataFrame, asked: int, starts: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", length: int = LENGTH) -> DataFrame:
    """queries with routes: the `asked` partitions of each, with up to `starts` rows to begin at. No query moves.

    entry: entry_graph(); means: (part, mean) of the partitions, for those that the sample's nearest rows don't lie in.
    """
    row = entry.first()
    centre = means.select("part", "mean").orderBy("part").collect()  # a row for each partition
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(({**row.asDict(), "labels": None}, np.array(row["labels"], dtype=np.int64), np.array([r.part for r in centre], dtype=np.int64), np.array([r["mean"] for r in centre])))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields) + f", routes {ROUTED}"
    if "routes" in queries.columns:
        raise ValueError("queries have a column routes already")

    def run(batches):
        graph, part_of, parts, centres = sent.value
        g = Searchable(graph)
        for pdf in batches:
            if not len(pdf):
                continue
            q, found = np.stack(pdf[vec_col]).astype(np.float64), []
            far = (q * q).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * q @ centres.T
            for at in blocks(len(q), g.n):
                own = q[at]
                nodes = search_block(g.near, by_norms("l2", own.astype(np.float32), g.x, g.norms), [[g.start]] * len(own), length).nodes
                for r, mine in enumerate(nodes):
                    met: dict[int, list[int]] = {}
                    for i in mine[mine >= 0].tolist():
                        met.setdefault(int(part_of[i]), []).append(int(g.ids[i]))
                    for p in parts[np.argsort(far[at][r], kind="stable")].tolist():
                        if len(met) >= asked:
                            break
                        met.setdefault(p, [])
                    found.append([{"part": p, "ids": ids[:starts]} for p, ids in list(met.items())[:asked]])
            yield pdf.assign(routes=pd.Series(found, index=pdf.index))

    return queries.mapInPandas(run, schema)


def routed_search(queries: DataFrame, local: DataFrame, entry: DataFrame, params: SearchParams, asked: int, book: Quantiser | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """search_partitions() where each query asks `asked` partitions, those that the entry graph leads to."""
    own = routes(queries.select(id_col, vec_col), entry, local, asked, id_col=id_col, vec_col=vec_col)
    return search_partitions(own, local, params, book, id_col, vec_col, routes="routes")
