"""Kernels, plans, sources and the index on small inputs and odd ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.index import VectorIndex
from orrery.operators import convert as X
from orrery.operators import graph as G
from orrery.operators import kernels as N
from orrery.operators import labels as L
from orrery.operators import partitioning as P
from orrery.operators import quantise as Q
from orrery.operators import ranking as R
from orrery.operators import recall as C
from orrery.operators.knn import knn
from orrery.plans import build as B
from orrery.plans import search as S


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(16, 12))
    return (middle[rng.integers(16, size=400)] + rng.normal(scale=0.2, size=(400, 12))).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark, x):
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").repartition(3).cache()


def brute(x, q, k, metric="l2"):
    x, q = x.astype(np.float64), q.astype(np.float64)
    d = ((x - q) ** 2).sum(1) if metric == "l2" else -(x @ q) if metric == "inner_product" else 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    return np.lexsort((np.arange(len(x)), d))[:k].tolist()


@pytest.mark.parametrize("metric", V.METRICS)
def test_knn_is_exact(table, x, metric):
    got = knn(table.filter("vec_id % 40 = 0"), table, 7, metric).orderBy("qid", "rank").collect()
    for q in range(0, 400, 40):
        assert [r.id for r in got if r.qid == q] == brute(x, x[q], 7, metric)


def test_knn_ties_zero_vectors_and_nulls(spark):
    rows = [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (7, None), (5, [0.0, 1.0])]
    base = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = knn(base.filter("vec_id = 1"), base, 2).orderBy("rank").collect()
    assert [(r.id, r.dist) for r in got] == [(1, 0.0), (3, 0.0)]
    assert {r.id: r.dist for r in knn(base.filter("vec_id = 2"), base, 4, "cosine").collect()} == {1: 1.0, 2: 1.0, 3: 1.0, 5: 1.0}
    assert knn(base.limit(0), base, 2).count() == 0 and knn(base, base.limit(0), 2).count() == 0
    for bad in (lambda: knn(base, base, 0), lambda: knn(base, base, 3, "hamming"), lambda: knn(base, base, -1)):
        with pytest.raises(ValueError):
            bad()


def test_recall_extends_ties(spark):
    truth = spark.createDataFrame([(1, i, d, r + 1) for r, (i, d) in enumerate([(1, 0.0), (2, 1.0), (3, 1.0), (4, 2.0)])], "qid long, id long, dist double, rank int")
    result = spark.createDataFrame([(1, 1, 1), (1, 3, 2)], "qid long, id long, rank int")
    assert C.recall_with_ties(truth, result, 2).first().recall == 1.0


def test_percentiles_and_numbers(spark):
    values = [(float((i * 37) % 101),) for i in range(300)]
    df = spark.createDataFrame(values, "v double").repartition(5)
    got = {r.share: r.value for r in R.percentiles(df, "v", [0.0, 0.5, 0.999, 1.0]).collect()}
    s = sorted(v for v, in values)
    assert got == {0.0: s[0], 0.5: s[150], 0.999: s[299], 1.0: s[299]}
    assert sorted(r.number for r in R.numbered(df, "v").collect()) == list(range(300))


def test_partition_sizes_and_budget():
    with pytest.raises(ValueError):
        P.least_partitions(0, 4, 1e6)
    p = P.least_partitions(100_000, 64, 10e6)
    assert 2 * P.index_bytes(-(-100_000 // p), 64) <= 10e6 < 2 * P.index_bytes(-(-100_000 // (p - 1)), 64)


def test_contiguous_partitions(spark):
    for n, parts in ((10, 3), (3, 5), (7, 1), (8, 4)):
        got = [r.p for r in spark.range(n).select("id", P.contiguous("id", n, parts).alias("p")).orderBy("id").collect()]
        sizes = [n // parts + (i < n % parts) for i in range(parts)]
        assert got == [i for i, s in enumerate(sizes) for _ in range(s)]


def test_allow_list_refuses(spark):
    for bad in ("1 1", "0 9", "a b", "1", "1 2 3"):
        with pytest.raises(Exception, match="not a pair"):
            P.allowed_pairs(spark.createDataFrame([(bad,)], "value string"), 4).collect()


def test_capped_assignment_keeps_caps(table):
    near = P.nearest_centres(table, [(i, [0.0] * 12) for i in range(4)], 4).select(F.col("vec_id").alias("id"), "nearest")
    got = P.capped_assignment(near, cap=110, copies=1)
    assert got.count() == 400 and got.groupBy("centre").count().agg(F.max("count")).first()[0] <= 110
    with pytest.raises(Exception, match="no centre has room"):
        P.capped_assignment(near, cap=50, copies=1).collect()


def test_labels(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, [2, 3])], "id long, t array<int>")
    ask = lambda f, q: [r.id for r in df.filter(f(F.col("t"), F.array(*map(F.lit, q)).cast("array<int>"))).orderBy("id").collect()]
    assert ask(L.any_common, [2]) == [1, 3] and ask(L.any_common, []) == [] and ask(L.has_all, []) == [1, 2, 3] and ask(L.has_all, [2, 3]) == [3]
    with pytest.raises(ValueError):
        L.synthetic(df, "id", "other", 3)


def test_vamana_recall_and_degrees(x):
    g = N.Vamana(x, degree=16, length=40).build()
    assert max(map(len, g.nbrs)) <= 16
    hits = sum(len(set(brute(x, q, 5)) & {i for _, i in g.search(q.astype(np.float64), 30)["pool"][:5]}) for q in x[:50])
    assert hits / 250 > 0.95


def test_updates_of_a_graph(x):
    g = N.Vamana(x[:300], degree=16, length=40).build()
    assert g.insert(x[300:320]) == range(300, 320) and max(map(len, g.nbrs)) <= 16
    for p in range(0, 100):
        g.delete(p)
    found = {i for _, i in g.search(x[5].astype(np.float64), 30)["pool"]}
    assert found and not found & set(range(100))
    assert g.consolidate() > 0
    assert not any(v < 100 for own in g.nbrs for v in own) and g.start >= 100
    live = x[100:320]
    hits = sum(len({i + 100 for i in brute(live, q, 5)} & {i for _, i in g.search(q.astype(np.float64), 40)["pool"][:5]}) for q in live[:40])
    assert hits / 200 > 0.9
    assert g.compact().tolist() == list(range(100, 320)) and len(g.nbrs) == len(g.x) == 220 and max(v for own in g.nbrs for v in own) < 220
    hits = sum(len(set(brute(live, q, 5)) & {i for _, i in g.search(q.astype(np.float64), 40)["pool"][:5]}) for q in live[:40])
    assert hits / 200 > 0.9


def test_filtered_prune_keeps_labels(x):
    labels = [{i % 4} for i in range(len(x))]
    chosen = N.robust_prune(0, np.arange(1, 60), x.astype(np.float64), 20, labels=labels)
    assert any(i % 4 == 0 for i in chosen)


def test_refinement_modes():
    x = np.arange(40, dtype=float)[:, None]
    near = lambda to: [((i - to) ** 2, i) for i in sorted(range(40), key=lambda i: abs(i - to))]
    q, pool, of = np.array([3.2]), near(3.0), lambda at: x[at]
    for mode, n in (("full", 40), ("fixed_count", 6), ("fixed_ratio", 10)):
        best, done = N.refine(q, pool, of, 5, mode, count=6, ratio=0.25)
        assert done == n and [i for _, i, _ in best] == [3, 4, 2, 5, 1]
    best, done = N.refine(q, pool, of, 5, "early_exit", batch=6, streak=2)
    assert done == 12 and all(r for *_, r in best)  # the five best by approximate distances are the five best by exact ones
    best, done = N.refine(q, pool, of, 5, "fixed_count", count=2)
    assert done == 2 and sum(r for *_, r in best) <= 2  # fewer than k
    assert N.refine(q, near(30.0), of, 5, "full")[0][0][1] == 3


def test_quantiser(table, x):
    assert Q.chunk_offsets(10, 4) == [0, 3, 6, 8, 10]
    with pytest.raises(ValueError):
        Q.chunk_offsets(3, 4)
    with pytest.raises(ValueError):
        Q.train(table, 3, centres=1000)
    plain, turned = Q.train(table, 4, centres=32), Q.train(table, 4, centres=32, rotate=4)
    for book in (plain, turned):
        codes = book.encode(x.astype(np.float64))
        error = ((book.inflate(codes) - x) ** 2).sum() / ((x - x.mean(0)) ** 2).sum()
        assert error < 0.2
        t = book.table(x[7].astype(np.float64))
        near = ((book.inflate(codes) - x[7]) ** 2).sum(1)
        assert np.allclose(t[np.arange(4), codes].sum(1), near)


def test_plans_recall(table, x):
    params = B.BuildParams(partitions=3, degree=16, length=40)
    graph = B.build_graph(table, params)
    assert graph.groupBy("src").count().agg(F.max("count")).first()[0] <= 16 and graph.filter("src = dst").count() == 0
    local = B.local_graphs(B.partitioned(table, params), params)
    got = S.search_partitions(table.filter("vec_id % 20 = 0"), local, S.SearchParams(k=5, length=30)).collect()
    hits = sum(r.id in brute(x, x[r.qid], 5) for r in got)
    assert hits / 100 > 0.95
    for bad in (dict(k=0), dict(k=11, length=10), dict(mode="other"), dict(beam=0)):
        with pytest.raises(ValueError):
            S.SearchParams(**bad)
    with pytest.raises(ValueError):
        B.BuildParams(degree=0)


def test_range_search_on_graphs(table):
    params = B.BuildParams(partitions=2, degree=16, length=40)
    local = B.local_graphs(B.partitioned(table, params), params)
    asked = table.filter("vec_id % 40 = 0")
    exact, got = knn(asked, table, 0, radius=0.8), S.range_search(asked, local, 0.8)
    assert got.join(exact, ["qid", "id"], "left_anti").count() == 0
    assert got.count() >= 0.95 * exact.count() > 0
    assert S.visit_counts(asked, local, S.SearchParams(k=5, length=20)).agg(F.max("visits")).first()[0] <= 10


def test_conversions(spark):
    df = spark.createDataFrame([(1, [1.5, -2.5, 999.0])], "id long, v array<float>")
    assert df.select(X.to_integers("v", "int8")).first()[0] == [1, -3, 127]
    assert df.select(X.to_integers("v", "uint8")).first()[0] == [1, 0, 255]
    with pytest.raises(ValueError):
        X.to_integers("v", "int7")
    with pytest.raises(Exception, match="not 4 elements"):
        df.select(X.to_tsv("v").alias("line")).select(X.from_tsv("line", 4)).collect()
    a, b = X.clustered(spark, 50, 4, partitions=2), X.clustered(spark, 50, 4, partitions=5)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_filtered_search(table):
    params = B.BuildParams(partitions=2, degree=16, length=40)
    rows = table.withColumn("labels", F.array("label"))
    local = B.local_graphs(B.partitioned(rows, params, labels="labels"), params)
    got = S.search_partitions(rows.filter("vec_id % 40 = 0"), local, S.SearchParams(k=5, length=40), label_col="label")
    assert got.filter("id % 3 <> qid % 3").count() == 0
    exact = knn(rows.filter("vec_id % 40 = 0"), rows, 5, match=("label", "label"))
    assert got.join(exact, ["qid", "id"], "left_semi").count() >= 0.8 * exact.count()


def test_bfs_and_layout(spark, table):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (9, 0)], "src long, dst long").withColumn("pos", F.lit(0))
    assert {r.node: r.level for r in G.bfs_levels(e, 0).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert G.layout(table, G.adjacency(e), 0).count() == 400


def test_index_finds_live_rows_behind_deleted_ones(spark, table, x):
    index = VectorIndex.build(table, B.BuildParams(partitions=2, degree=24, length=60))
    gone = brute(x, x[7], 150)
    index, _ = index.delete(spark.createDataFrame([(i,) for i in gone], "tag long"))
    got = [r.id for r in index.search(table.filter("vec_id = 7"), S.SearchParams(k=10, length=30)).orderBy("rank").collect()]
    want = [i for i in brute(x, x[7], 400) if i not in set(gone)][:10]
    assert len(got) == 10 and not set(got) & set(gone) and len(set(got) & set(want)) >= 8
