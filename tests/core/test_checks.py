"""Round 4: what inserts cut off is taken in, and searches on poor graphs are whole by their checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_whole import points, table_of

from orrery import catalogue as C
from orrery.operators import graph as G
from orrery.operators.kernels import Vamana
from orrery.plans import build as B
from orrery.plans import frontier as J


def test_an_insert_leaves_no_row_cut_off(spark):
    df, degree = table_of(spark, points(240)), 4
    g = Vamana(points(240)[:160], degree, 16).build()
    edges = spark.createDataFrame([(p, v) for p, own in enumerate(g.nbrs) for v in own], "src bigint, dst bigint")
    start = spark.createDataFrame([(g.start,)], "id bigint")
    after = J.insert(edges, df.filter("vec_id < 160"), df.filter("vec_id >= 160"), start, degree, 16)
    assert G.bfs_levels(after, 0).count() == 240
    assert after.groupBy("src").count().agg(F.max("count")).first()[0] <= degree


def test_a_check_adds_what_a_search_by_joins_has_missed(spark):
    df = table_of(spark, points(60))
    ring = spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)] + [(i, 30 + (i + 1) % 30) for i in range(30, 60)], "src bigint, dst bigint")
    start = spark.createDataFrame([(0,)], "id bigint")
    found = J.graph_search(df, ring, df, start, 5, 10, check=True).collect()
    wanted = {(r.qid, r.id, r["rank"]) for r in C.knn(df, df, 5).collect()}
    assert {(r.qid, r.id, r["rank"]) for r in found} == wanted and not all(r.own for r in found)
    with pytest.raises(ValueError, match="check"):
        J.graph_search(df, ring, df, start, 5, 10, expanded=True, check=True)


@pytest.mark.parametrize("name", ["final_graph_search_facts", "sampled_entries_facts"])
def test_searches_by_joins_are_whole_on_a_graph_that_leads_nowhere(spark, sf, monkeypatch, name):
    monkeypatch.setattr(C, "final_graph", lambda df: df.sparkSession.createDataFrame([(0, i) for i in range(1, 20)], "src bigint, dst bigint"))
    row = C.QUERIES[name](spark, sf).first()
    assert (row.queries, row.fewest, row.repeated, row.recall_holds) == (10, 10, 0, True)


@pytest.mark.parametrize("name", ["tiered_index_facts", "universal_label_facts"])
def test_recall_holds_on_poor_graphs(spark, monkeypatch, tmp_path, name):
    x = np.random.default_rng(3).normal(size=(1600, 24))
    table_of(spark, x / np.linalg.norm(x, axis=1, keepdims=True)).withColumn("label", (F.col("vec_id") % 10).cast("int")).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(C, "PARAMS", B.BuildParams(partitions=C.PARTS, degree=3, length=4))
    row = C.QUERIES[name](spark, str(tmp_path)).first()
    assert (row.queries, row.fewest, row.repeated, row.recall_holds) == (32, 10, 0, True)


def test_pairs_that_probing_finds_are_kept_in_blocks(spark, monkeypatch):
    kept, plain, params = {}, B.stored, B.BuildParams(partitions=2, degree=6, length=12)
    monkeypatch.setattr(B, "stored", lambda df, name: kept.setdefault(name, plain(df, name)))
    graphs = B.local_graphs(B.partitioned(table_of(spark, points(300)), params), params)
    edges = B.cross_edges(graphs, B.all_pairs(spark, 2), params)
    found = edges.collect()
    assert all((r.src < 150) != (r.dst < 150) for r in found) and {r.src for r in found} == set(range(300))
    assert kept["probed"].count() == 4  # 150 rows of each side in one block, under both ways


def test_a_checked_probe_leads_more_rows_to_their_nearest_elsewhere(spark, monkeypatch):
    x, params = points(300), B.BuildParams(partitions=2, degree=4, length=4)
    graphs = B.local_graphs(B.partitioned(table_of(spark, x), params), params)
    small = x[150:].astype(np.float32)
    monkeypatch.setattr(B, "COMPARED", 64)
    assert B.nearest_of(x[:150].astype(np.float32), small, (small * small).sum(axis=1)).tolist() == ((x[:150, None] - x[None, 150:]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    hits = lambda check: sum(((x[r.src] - x[r.dst]) ** 2).sum() == ((x[r.src] - x[150 * (r.src < 150):][:150]) ** 2).sum(axis=1).min() for r in B.cross_edges(graphs, B.all_pairs(spark, 2), params, check=check).collect())
    assert hits(True) > hits(False)
