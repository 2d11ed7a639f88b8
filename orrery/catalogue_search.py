"""More registered queries: searches by several metrics, with codes of bits, widening beams and routes.

Those with SQL search until every row is in the pool, so that their answer is the exact one whatever the graphs are; the
others return what each query found of its true neighbours, and with what work.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.catalogue import EVERY, L2_SQL, PARAMS, PRUNED, SQL, TOP, K, asked, base, book, centres, dot, edges, knn_sql, local, n2, query, rounded, truth
from orrery.index import VectorIndex
from orrery.operators import partitioning as P
from orrery.operators import quantise as Q
from orrery.operators import recall as C
from orrery.operators import updates as U
from orrery.operators.knn import knn
from orrery.plans import build as B
from orrery.plans import routing as R
from orrery.plans import search as S
from orrery.storage import stored

#: Partitions of routed searches, how many of them a query asks, and the sample's share; two beams to compare, and the lengths of their pools.
ROUTED, ASKED, SHARE, LENGTHS = 40, 10, 0.05, (20, 40, 80)


def whole(df: DataFrame, **more) -> S.SearchParams:
    return S.SearchParams(k=K, length=df.count(), **more)


def result(found: DataFrame) -> DataFrame:
    return rounded(found.select("qid", "id", "dist", "rank"))


def hits(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, truth, hits, comparisons, expanded) of each query."""
    found = stored(found, "found")
    work = found.groupBy("qid").agg(*[F.max(c).alias(c) for c in ("comparisons", "expanded", "rounds")])
    both = wanted.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return both.groupBy("qid").agg(F.count(F.lit(1)).alias("truth"), F.count("hit").alias("hits")).join(work, "qid", "left")


# -- one graph search for many queries ------------------------------------------------
@query(f"{knn_sql(L2_SQL)} {TOP}")
def pipelined_search_full_pool(spark, d):
    """Beams that widen, with every row in the pool."""
    df = base(spark, d)
    return result(S.search_partitions(asked(df), local(df), whole(df, beam=32, widen=True, entries=4)))


@query()
def pipelined_search_work(spark, d):
    """For each length and query, what a fixed beam and one that widens and stops early find, and the work of the busiest partition."""
    df = base(spark, d)
    graphs, wanted, out = local(df), stored(truth(df), "truth"), None
    for length in LENGTHS:
        for kind, params in (("fixed", S.SearchParams(k=K, length=length)), ("widening", S.SearchParams(k=K, length=length, widen=True)), ("early", S.SearchParams(k=K, length=length, widen=True, patience=length // 2))):
            row = hits(S.search_partitions(asked(df), graphs, params), wanted).select(F.lit(length).alias("length"), F.lit(kind).alias("beam"), "*")
            out = row if out is None else out.unionByName(row)
    return out


@query(f"{knn_sql('1 - ' + dot('q.v', 'b.v') + ' / (sqrt(' + n2('q.v') + ') * sqrt(' + n2('b.v') + '))')} {TOP}")
def cosine_index_full_pool(spark, d):
    """An index built for cosine, searched with every row in the pool."""
    df = base(spark, d)
    return result(VectorIndex.build(df, PARAMS, metric="cosine").search(asked(df), whole(df, entries=4)))


@query(f"{knn_sql('-' + dot('q.v', 'b.v'))} {TOP}")
def inner_product_index_full_pool(spark, d):
    """An index built for inner products, on lifted vectors, searched with every row in the pool."""
    df = base(spark, d)
    return result(VectorIndex.build(df, PARAMS, metric="inner_product").search(asked(df), whole(df, entries=4)))


@query()
def metric_index_hits(spark, d):
    """For each metric and query, what an index of vectors of many lengths finds of the true neighbours."""
    df = base(spark, d)
    long = df.withColumn("embedding", F.transform("embedding", lambda x: (x * (1 + F.pmod(F.col("vec_id") * 7, F.lit(10)) / 10.0)).cast("float")))
    out = None
    for metric in ("l2", "cosine", "inner_product"):
        found = S.search_partitions(asked(long), VectorIndex.build(long, PARAMS, metric=metric).graphs, S.SearchParams(k=K, length=80), metric=metric)
        row = hits(found, knn(asked(long), long, K, metric)).select(F.lit(metric).alias("metric"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# -- codes of bits --------------------------------------------------------------------
def coded(df: DataFrame, bits: int) -> tuple[DataFrame, Q.RotatedBits]:
    own = Q.RotatedBits.train(df, bits, 16)
    return B.local_graphs(B.partitioned(df, PARAMS), PARAMS, own), own


@query(f"{knn_sql(L2_SQL)} {TOP}")
def rotated_bits_full_pool(spark, d):
    """Ranked by codes of one bit a dimension, with every row in the pool, and exact distances at the end."""
    df = base(spark, d)
    graphs, bits = coded(df, 1)
    return result(S.search_partitions(asked(df), graphs, whole(df, entries=4), bits))


@query()
def rotated_bits_hits(spark, d):
    """For each number of bits and query, what a search by codes finds, and the bytes of a code."""
    df = base(spark, d)
    graphs, trained, wanted, out = local(df), Q.RotatedBits.train(df, 1, 16), stored(truth(df), "truth"), None
    for bits in (1, 2, 4, 8):
        own = replace(trained, bits=bits)  # neither graphs nor centres depend on it
        row = hits(S.search_partitions(asked(df), B.with_codes(graphs, own), S.SearchParams(k=K, length=80), own), wanted).select(F.lit(bits).alias("bits"), F.lit(own.width).alias("code_bytes"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# -- routes -----------------------------------------------------------------------------
def routed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs of partitions by k-means' centres, and the entry graph over a sample."""
    params = replace(PARAMS, partitions=ROUTED)
    parts = R.by_centres(df, ROUTED)
    return B.local_graphs(parts, params), R.entry_graph(parts, SHARE)


@query(f"{knn_sql(L2_SQL)} {TOP}")
def routed_search_of_all_partitions(spark, d):
    """The exact way of routing: all partitions are asked, and every row is in the pool."""
    df = base(spark, d)
    graphs, entry = routed(df)
    return result(R.routed_search(asked(df), graphs, entry, whole(df, entries=4), ROUTED))


@query()
def routed_search_hits(spark, d):
    """For each number of partitions asked and query, what a routed search finds, and the most that any choice of partitions holds."""
    df = base(spark, d)
    graphs, entry = routed(df)
    graphs, wanted, out = stored(graphs, "graphs"), stored(truth(df), "truth"), None
    where = graphs.select("part", F.explode("ids").alias("id"))
    held = wanted.join(where, "id").groupBy("qid", "part").agg(F.count(F.lit(1)).alias("n"))
    for n in (ASKED, 2 * ASKED, ROUTED):
        best = held.groupBy("qid").agg(F.aggregate(F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, n), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("best"))
        row = hits(R.routed_search(asked(df), graphs, entry, S.SearchParams(k=K, length=40), n), wanted).join(best, "qid").select(F.lit(n).alias("asked"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# -- deletes merged into lists, on codes --------------------------------------------------
MERGED_SQL = f"""df AS (SELECT src, dst, min(pos) AS pos FROM e GROUP BY src, dst), dk AS (SELECT src, dst FROM df WHERE src % 7 <> 0),
    ds AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY pos, dst) AS n FROM df WHERE src % 7 = 0 AND dst % 7 <> 0),
    dx AS (SELECT src, dst FROM dk WHERE dst % 7 <> 0 UNION SELECT dk.src, ds.dst FROM dk JOIN ds ON ds.src = dk.dst WHERE ds.n <= 3), dm AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM dx WHERE src <> dst),
    m AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS location FROM embeddings WHERE vec_id % 7 <> 0), c AS (SELECT src, dst FROM dm WHERE n > {PRUNED})"""


@query(SQL["t_occlusion_prune_on_codes"].replace("c AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst)", MERGED_SQL).replace(
    f"SELECT src, pos, dst, round(d / 1e6, 6) AS dist FROM f WHERE pos < {PRUNED}",
    f"SELECT s.location AS src, t.location AS dst FROM (SELECT src, dst FROM f WHERE pos < {PRUNED} UNION ALL SELECT src, dst FROM dm WHERE n <= {PRUNED}) g JOIN m s ON s.vec_id = g.src JOIN m t ON t.vec_id = g.dst"))
def delete_merge_on_codes(spark, d):
    """A seventh of the rows leaves the lists; long ones are pruned by code distances, and all are numbered densely."""
    df = base(spark, d)
    return U.delete_merge_on_codes(edges(df), df.filter(F.col("vec_id") % 7 == 0).select(F.col("vec_id").alias("id")), df, book(df), PRUNED, 3, 0)[0]


# -- k-means over all rows --------------------------------------------------------------
@query(SQL["kmeans_two_rounds"])
def kmeans_by_bounds(spark, d):
    """Two rounds of k-means in which bounds leave distances out: what kmeans_two_rounds gives."""
    df = base(spark, d)
    found, _, _ = P.kmeans_by_bounds(df, np.array([v for _, v in centres(df)]), 2)
    rows = [(c, j, float(x)) for c, row in enumerate(found) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "centre bigint, pos int, mean double").withColumn("mean", F.round("mean", 5))


@query()
def kmeans_work(spark, d):
    """From oversampled seeds and from random rows: the residual of each round, and the distances computed with bounds, of how many."""
    df, out = base(spark, d), []
    n = df.count()
    for kind, first in (("oversampled", P.seeds(df, 16)), ("random", P.random_pivots(df, 16))):
        _, residuals, asked = P.kmeans_by_bounds(df, first, 8)
        out += [(kind, r, x, asked, n * 16 * len(residuals)) for r, x in enumerate(residuals)]
    return spark.createDataFrame(out, "seeds string, round int, residual double, distances bigint, most bigint")


# -- truth of windows over all rows -----------------------------------------------------
@query(f"""WITH w AS (SELECT s AS step, s * (n - n * 2 // 5) // 5 AS first, n * 2 // 5 AS width FROM (SELECT count(*) AS n FROM embeddings), range(6) t(s)), b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    r AS (SELECT step, q.vec_id AS qid, b.vec_id AS id, {L2_SQL} AS dist FROM b q JOIN w ON q.vec_id % {EVERY} = 0 JOIN b ON b.vec_id >= first AND b.vec_id < first + width),
    x AS (SELECT *, row_number() OVER (PARTITION BY step, qid ORDER BY dist, id) AS rank FROM r) SELECT step, qid, rank, id, round(dist, 6) AS dist FROM x WHERE rank <= 10""")
def sliding_window_gt(spark, d):
    """The true neighbours in six windows of two fifths of all rows, from the first to the last: of all rows of each window."""
    df = base(spark, d)
    n = df.count()
    width = n * 2 // 5
    return rounded(C.truth_of_windows(asked(df), df, [(s, s * (n - width) // 5) for s in range(6)], width, K))
