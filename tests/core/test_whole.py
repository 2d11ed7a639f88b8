"""Graphs whose nodes are all reached, pools that hold every row, and exact checks after a search."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orrery.operators import knn as N
from orrery.operators.kernels import Vamana
from orrery.operators.knn import knn
from orrery.plans import build as B
from orrery.plans import frontier as J
from orrery.plans import search as S
from orrery.sources import vector_files


def points(n, dim=16, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reached(g):
    seen, front = {g.start}, [g.start]
    while front:
        front = [v for v in {w for u in front for w in g.nbrs[u]} if v not in seen]
        seen.update(front)
    return len(seen)


def table_of(spark, x):
    return spark.createDataFrame([(i, own) for i, own in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")


def test_every_node_is_reached_within_the_degree():
    for x, degree in ((points(400), 3), (np.vstack([points(60), np.repeat(points(2, seed=9), 80, axis=0)]), 4)):
        g = Vamana(x, degree, 16, 1.0).build()
        assert reached(g) == len(x) and max(map(len, g.nbrs)) <= degree
        g.insert(points(90, seed=3))
        assert reached(g) == len(x) + 90 and max(map(len, g.nbrs)) <= degree
        for p in range(0, len(x), 3):
            g.delete(p)
        g.consolidate()
        assert len(g.compact()) == len(g.nbrs) == reached(g)


def test_a_pool_for_every_row_is_not_sorted_round_by_round(spark):
    x = points(700)
    df = table_of(spark, x)
    graphs = B.local_graphs(B.partitioned(df, B.BuildParams(partitions=3, degree=3)), B.BuildParams(partitions=3, degree=3))
    found = S.search_partitions(df.filter("vec_id % 20 = 0"), graphs, S.SearchParams(k=7, length=700)).collect()
    wanted = knn(df.filter("vec_id % 20 = 0"), df, 7).collect()
    key = lambda rows: sorted((r.qid, r["rank"], r.id) for r in rows)
    assert key(found) == key(wanted)
    assert max(r.rounds for r in found) < 60  # the graph's depth, not a round for every eighth row


def test_a_filter_after_a_whole_pool_moves_no_list_of_all_rows(spark, monkeypatch):
    df = table_of(spark, points(300))
    params = B.BuildParams(partitions=2, degree=6)
    graphs = B.local_graphs(B.partitioned(df, params), params)
    asked = df.filter("vec_id % 30 = 0")
    own, asked_for = S.search_partitions, []
    monkeypatch.setattr(S, "search_partitions", lambda q, g, p, *a, **k: asked_for.append(p.k) or own(q, g, p, *a, **k))
    got = S.post_filtered(asked, graphs, df, F.col("vec_id") % 3 == 0, S.SearchParams(k=5, length=300, mode="expanded"))
    key = lambda rows: sorted((r.qid, r["rank"], r.id) for r in rows)
    assert key(got.collect()) == key(knn(asked, df.filter("vec_id % 3 = 0"), 5).collect())
    assert asked_for == [5]  # not a list of 300 for each query


def test_a_check_finds_what_a_short_search_misses(spark):
    df = table_of(spark, points(900, 32))
    params = B.BuildParams(partitions=2, degree=4, length=8)
    graphs, asked = B.local_graphs(B.partitioned(df, params), params), df.filter("vec_id % 20 = 0")
    wanted = {(r.qid, r.id) for r in knn(asked, df, 10).collect()}
    plain = S.search_partitions(asked, graphs, S.SearchParams(k=10, length=10)).collect()
    checked = S.search_partitions(asked, graphs, S.SearchParams(k=10, length=10, check=True)).collect()
    assert {(r.qid, r.id) for r in plain} != wanted == {(r.qid, r.id) for r in checked}
    assert all(r.missed == 0 for r in plain) and any(r.missed > 0 for r in checked)


def test_a_pool_for_every_row_needs_the_graphs_depth_in_hops(spark):
    x = points(240)
    df = table_of(spark, x)
    edges = df.select(F.col("vec_id").alias("src"), F.explode(F.array(*[F.pmod(F.col("vec_id") * 3 + j, F.lit(240)) for j in (1, 2, 3)])).alias("dst"))
    found = J.graph_search(df.filter("vec_id % 60 = 0"), edges, df, spark.createDataFrame([(0,)], "id bigint"), 5, 240, 4, most=12).collect()
    wanted = knn(df.filter("vec_id % 60 = 0"), df, 5).collect()
    assert sorted((r.qid, r["rank"], r.id) for r in found) == sorted((r.qid, r["rank"], r.id) for r in wanted)
    assert {r.comparisons for r in found} == {240} and max(r.hops for r in found) < 12


def test_pairs_within_a_radius_are_passed_on_batch_by_batch():
    x, taken = points(60), []
    sent = SimpleNamespace(value=(np.arange(2), x[:2], None))

    def batches():
        for a in range(0, 60, 20):
            taken.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 20)), pa.array(list(x[a : a + 20]))], names=["id", "v"])

    out = N._nearest(sent, 0, "l2", 5.0, False)(batches())
    assert next(out).num_rows == 40 and taken == [0]
    assert sum(b.num_rows for b in out) == 80


def test_a_range_truth_file_is_read_in_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_files, "IDS_A_SPLIT", 7)
    lists = {q: [(q * 5 + i) % 50 for i in range(q % 4 * 3)] for q in range(12)}
    truth = spark.createDataFrame([(q, i, float(n)) for q, own in lists.items() for n, i in enumerate(own)], "qid bigint, id bigint, dist double")
    path = str(tmp_path / "range")
    vector_files.write_range_truth(truth, spark.createDataFrame([(q,) for q in lists], "qid bigint"), path)
    got = vector_files.range_truth_rows(spark, path)
    assert {r.qid: r.ids for r in got.collect()} == lists and got.rdd.getNumPartitions() > 1
    data = np.fromfile(path, "<u4").tolist()
    assert data == [12, sum(map(len, lists.values())), *map(len, lists.values()), *[i for own in lists.values() for i in own]]
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".part"] == []


def test_nodes_within_a_radius_are_found_without_a_pool_for_them():
    x = points(900, 24).astype(np.float32)
    g = Vamana(x.astype(float), 8, 24, 1.0).build()
    row = B.as_row(0, np.arange(900), g).iloc[0].to_dict()
    pieces = list(S.Searchable(row).within(x[::90].astype(float), 1.5, 16, None))
    got = {(int(r), int(i)) for rows, nodes, _ in pieces for r, i in zip(rows, nodes, strict=True)}
    want = {(r, i) for r, q in enumerate(x[::90].astype(float)) for i in np.flatnonzero(((x - q) ** 2).sum(axis=1) <= 1.5).tolist()}
    assert got <= want and len(got) >= 0.97 * len(want)
