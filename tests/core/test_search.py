"""Searching many queries at once, by metrics, codes and routes; an index of which only touched partitions change."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import brute, table, x  # noqa: F401  (fixtures)

from orrery.index import VectorIndex
from orrery.operators import batch as A
from orrery.operators import kernels as N
from orrery.operators.knn import knn
from orrery.plans import build as B
from orrery.plans import routing as R
from orrery.plans import search as S

PARAMS = B.BuildParams(partitions=4, degree=16, length=40)


@pytest.fixture(scope="module")
def graph(x):
    return N.Vamana(x.astype(np.float64), 12, 40, 1.2).build()


def opened(g):
    return A.padded(np.cumsum([0, *map(len, g.nbrs)]), np.array([v for own in g.nbrs for v in own], dtype=np.int32)), (g.x * g.x).sum(axis=1)


@pytest.mark.parametrize("beam,length,limit,dead", [(1, 20, None, 0), (4, 30, None, 0), (8, 10, None, 7), (3, 25, 12, 0), (2, 15, 9, 5)])
def test_blocks_find_what_single_queries_find(graph, x, beam, length, limit, dead):
    near, norms = opened(graph)
    queries = x[::9].astype(np.float64)
    alive = np.arange(len(x)) % dead != 0 if dead else None
    starts = [[graph.start, i % 50] for i in range(len(queries))]
    got = A.search_block(near, A.by_norms("l2", queries, graph.x, norms), starts, length, beam, limit, alive)
    own = list(got.expanded_of(len(queries)))
    for i, q in enumerate(queries):
        want = N.best_first(starts[i], lambda at: ((graph.x[at] - q) ** 2).sum(axis=1), lambda u: graph.nbrs[u], length, beam, limit, None if alive is None else alive.__getitem__)
        assert [v for _, v in want["pool"]] == got.nodes[i][got.nodes[i] >= 0].tolist()
        assert np.allclose([d for d, _ in want["pool"]], got.dists[i][: len(want["pool"])])
        assert want["expanded"] == own[i][0].tolist() and (want["rounds"], want["comparisons"]) == (got.rounds[i], got.comparisons[i])


def test_allowed_nodes(graph, x):
    near, norms = opened(graph)
    allowed = np.arange(len(x)) % 2 == 0
    start = int(np.flatnonzero(allowed)[0])
    got = A.search_block(near, A.by_norms("l2", x[:5].astype(np.float64), graph.x, norms), [[start]] * 5, 30, 4, allowed=allowed)
    assert all(allowed[v] for v in got.nodes[got.nodes >= 0])
    empty = A.search_block(near[:0], lambda r, a: np.zeros(len(r)), [[]], 5)
    assert empty.nodes.shape[0] == 1 and not (empty.nodes >= 0).any()


def test_widening_beams_and_early_ends(graph, x):
    near, norms = opened(graph)
    queries = x.astype(np.float64)
    score = A.by_norms("l2", queries, graph.x, norms)
    run = lambda **more: A.search_block(near, score, [[graph.start]] * len(x), 40, 16, **more)
    fixed, wide, early = run(), run(widen=True), run(widen=True, patience=15)
    recall = lambda f: np.mean([len(set(f.nodes[i][:10].tolist()) & set(brute(x, x[i], 10))) for i in range(0, len(x), 7)]) / 10
    assert recall(wide) >= recall(fixed) - 0.01 and recall(early) >= recall(fixed) - 0.03
    assert early.comparisons.mean() < wide.comparisons.mean() <= fixed.comparisons.mean()
    assert early.expanded.mean() < wide.expanded.mean() < fixed.expanded.mean() and wide.rounds.mean() > fixed.rounds.mean()


@pytest.mark.parametrize("metric", ["cosine", "inner_product"])
def test_index_of_other_metrics(table, metric):
    long = table.withColumn("embedding", F.transform("embedding", lambda v: (v * (1 + F.pmod(F.col("vec_id"), F.lit(7)))).cast("float")))
    index = VectorIndex.build(long.filter("vec_id % 5 <> 0"), PARAMS, metric=metric)
    index, _ = index.insert(long.filter("vec_id % 5 = 0 AND vec_id > 0"))
    index, _ = index.delete(long.filter("vec_id % 11 = 3").select(F.col("vec_id").alias("tag")))
    index, _ = index.consolidate()
    queries, rows = long.filter("vec_id % 20 = 1"), long.filter("vec_id > 0 AND vec_id % 11 <> 3")
    want = {(r.qid, r.id): r.dist for r in knn(queries, rows, 5, metric).collect()}
    got = {(r.qid, r.id): r.dist for r in index.search(queries, S.SearchParams(k=5, length=80)).collect()}
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-5, rel=1e-5) for k in set(got) & set(want))
    with pytest.raises(ValueError):
        S.search_partitions(queries, index.graphs, S.SearchParams(), book=object(), metric=metric)


def test_routes(spark, table, x):
    rng = np.random.default_rng(4)
    means = rng.normal(size=(40, 12)) * 4
    own = np.concatenate([m + rng.normal(size=(25, 12)) * 0.4 for m in means]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id bigint, embedding array<float>")
    parts = R.by_centres(rows, 40)
    local = B.local_graphs(parts, B.BuildParams(partitions=40, degree=16, length=40))
    entry = R.entry_graph(parts, 0.2)
    queries = rows.filter("vec_id % 10 = 3")
    want = {(r.qid, r.id) for r in knn(queries, rows, 10).collect()}
    found = lambda asked: {(r.qid, r.id) for r in R.routed_search(queries, local, entry, S.SearchParams(k=10, length=60), asked).collect()}
    assert len(found(10) & want) >= 0.95 * len(want)  # a quarter of the partitions
    assert found(1000) == want  # all of them
    routed = R.routes(queries, entry, local, 10).select("vec_id", F.size("routes").alias("n"), F.size(F.array_distinct(F.transform("routes", lambda r: r["part"]))).alias("m")).collect()
    assert all(r.n == r.m == min(10, local.count()) for r in routed)
    cut = R.by_centres(rows, 4, most=60)
    assert cut.count() == 1000 and cut.select("part").distinct().count() >= 1000 // 60
    with pytest.raises(ValueError):
        R.routes(queries.withColumn("routes", F.lit(1)), entry, local, 3)


def test_changes_write_what_they_touch(table):
    params = B.BuildParams(partitions=8, degree=16, length=40)
    index = VectorIndex.build(table.filter("vec_id >= 20"), params)
    assert sum(index.sizes.values()) == 380 and set(index.sizes) == set(index.parted_graphs.folders)
    more, refused = index.insert(table.filter("vec_id BETWEEN 1 AND 6"))
    changed = {p for p in more.sizes if more.parted_graphs.folders[p] != index.parted_graphs.folders[p]}
    assert len(changed) == 1 and refused.count() == 0 and sum(more.sizes.values()) == 386  # 6 rows are under a quarter of a partition
    assert all(more.sizes[p] == index.sizes[p] for p in set(index.sizes) - changed)
    part = sorted(set(more.sizes) - changed)[0]
    gone = more.parted_rows.read([part]).select("tag").limit(5)
    less, report = more.delete(gone)[0].consolidate()
    assert {p for p in less.sizes if less.parted_graphs.folders[p] != more.parted_graphs.folders[p]} == {part}
    assert {r.part: (r.rows, r.released) for r in report.collect()} == {p: (n, 5 if p == part else 0) for p, n in more.sizes.items()}
    assert less.rows.count() == 381 == sum(less.sizes.values()) and index.rows.count() == 380  # old versions stay as they are
    q = table.filter("vec_id IN (3, 100)")
    assert {(r.qid, r.id) for r in less.search(q, S.SearchParams(k=1, length=40)).collect()} >= {(3, 3)}


def test_partitions_over_the_budget_are_cut(table):
    params = B.BuildParams(degree=16, length=40, memory=60_000)
    index = VectorIndex.build(table.filter("vec_id % 4 = 0"), params)
    most = index.largest()
    grown, _ = index.insert(table.filter("vec_id > 0"))
    assert sum(grown.sizes.values()) == 400 and max(grown.sizes.values()) <= most and len(grown.sizes) > len(index.sizes)
    queries = table.filter("vec_id % 40 = 1")
    want = {(r.qid, r.id) for r in knn(queries, table, 5).collect()}
    got = {(r.qid, r.id) for r in grown.search(queries, S.SearchParams(k=5, length=60)).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_upsert(table):
    index = VectorIndex.build(table.filter("vec_id BETWEEN 1 AND 300"), PARAMS)
    moved = table.filter("vec_id BETWEEN 291 AND 310").withColumn("embedding", F.transform("embedding", lambda v: (v + 100).cast("float")))
    out = index.upsert(moved)
    assert out.rows.count() == 310 == out.rows.select("tag").distinct().count()
    now = {r.tag: r.vec[0] for r in out.rows.collect()}
    assert all((now[t] > 50) == (t > 290) for t in now)
    got = out.search(moved.filter("vec_id = 295"), S.SearchParams(k=3, length=60)).orderBy("rank").collect()
    assert got[0].id == 295 and got[0].dist == pytest.approx(0, abs=1e-6)


def test_rows_of_a_new_label_are_found(table):
    own = table.withColumn("labels", F.array((F.col("vec_id") % 3).cast("int")))
    index = VectorIndex.build(own.filter("vec_id >= 40"), PARAMS, labels="labels")
    new = own.filter("vec_id BETWEEN 1 AND 39").withColumn("labels", F.array(F.lit(77), (F.col("vec_id") % 3).cast("int")))
    index, _ = index.insert(new, labels="labels")
    index, _ = index.delete(new.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("tag")))
    index, _ = index.consolidate()
    for label, rows in ((77, new.filter("vec_id % 4 <> 0")), (1, own.filter("vec_id % 3 = 1 AND (vec_id >= 40 OR vec_id % 4 <> 0)"))):
        queries = table.filter("vec_id % 50 = 2").withColumn("want", F.lit(label))
        want = {(r.qid, r.id) for r in knn(queries, rows, 5).collect()}
        got = {(r.qid, r.id) for r in index.search(queries, S.SearchParams(k=5, length=80), label_col="want").collect()}
        assert len(got & want) >= 0.9 * len(want), label


def test_one_shot_build_with_labels(spark, table, tmp_path):
    from orrery.operators.partitioning import index_bytes
    from orrery.plans.oneshot import STAGES, merged_index

    own = table.withColumn("labels", F.array((F.col("vec_id") % 3).cast("int"), F.when(F.col("vec_id") < 60, 9).otherwise(8)))
    params = B.BuildParams(degree=24, length=60, alpha=1.2)
    build = lambda: merged_index(own, params, index_bytes(400, 12, degree=16) * 0.8, "labels", f"file://{tmp_path}/one")
    index = build()
    assert sorted(p.name for p in (tmp_path / "one").iterdir()) == sorted(STAGES) and index.medoids.count() >= 3
    entries = {r.label: r for r in index.entries.collect()}
    labels = {r.vec_id: r.labels for r in own.select("vec_id", "labels").collect()}
    assert set(entries) == {0, 1, 2, 8, 9} and all(label in labels[r.id] for label, r in entries.items())
    queries = own.filter("vec_id % 40 = 7")
    recall = lambda got, want: len({(r.qid, r.id) for r in got.collect()} & (w := {(r.qid, r.id) for r in want.collect()})) / len(w)
    assert recall(index.search(queries, 5, 60), knn(queries, own, 5)) >= 0.95
    for label in (1, 9):
        assert recall(index.search_label(queries, label, 5, 60), knn(queries, own.filter(F.array_contains("labels", label)), 5)) >= 0.9
    with pytest.raises(ValueError):
        index.search_label(queries, 77)
    stamps = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "one").iterdir()}
    assert build().edges.count() == index.edges.count()  # stages that are complete are read
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "one").iterdir()} == stamps
