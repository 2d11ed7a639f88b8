"""Searches by joins that fetch several lists at a time, and an exact check after searches that measure graphs."""

import numpy as np
from pyspark.sql import functions as F
from test_whole import points, table_of

from orrery.operators import graph as G
from orrery.operators.kernels import best_first
from orrery.operators.knn import knn
from orrery.operators.partitioning import all_pairs
from orrery.plans import build as B
from orrery.plans import frontier as J
from orrery.plans import search as S


def ring(spark, n: int, step: int = 7):
    """Edges from each node to those about it, and to one far away."""
    return spark.createDataFrame([(i, (i + j) % n) for i in range(n) for j in (1, 2, n - 1, step * (i % 5 + 2))], "src bigint, dst bigint")


def test_fetching_lists_ahead_finds_what_a_node_at_a_time_does_in_fewer_rounds(spark, monkeypatch):
    n, big = 200, 1 << 60  # ids that doubles don't hold
    x = points(n)
    df = table_of(spark, x).withColumn("vec_id", F.col("vec_id") + big)
    edges = ring(spark, n).select((F.col("src") + big).alias("src"), (F.col("dst") + big).alias("dst"))
    written, plain = [], J.stored
    monkeypatch.setattr(J, "stored", lambda t, name: written.append(name) or plain(t, name))
    start = spark.createDataFrame([(big,)], "id bigint")
    found = J.graph_search(df.filter("vec_id % 40 = 0"), edges, df, start, 5, 20, 1).collect()
    lists = {i: [] for i in range(n)}
    for r in edges.collect():
        lists[r.src - big].append(r.dst - big)
    for q in {r.qid for r in found}:
        own = sorted((r for r in found if r.qid == q), key=lambda r: r["rank"])
        alone = best_first([0], lambda at, q=q: ((x[at] - x[q - big]) ** 2).sum(axis=1), lambda u: sorted(set(lists[u])), 20, 1)
        assert [r.id - big for r in own] == [i for _, i in alone["pool"][:5]]
        assert {(r.hops, r.comparisons) for r in own} == {(alone["rounds"], alone["comparisons"])}
    assert written.count("frontier-followed") < max(r.hops for r in found)


def test_quality_with_a_check_tells_what_the_graph_alone_finds(spark):
    df = table_of(spark, points(200))
    q = df.filter("vec_id % 20 = 0")
    rows = {r.length: r for r in J.quality(q, ring(spark, 200), df, knn(q, df, 5), 0, [5, 12], 5, check=True).collect()}
    plain = {r.length: r for r in J.quality(q, ring(spark, 200), df, knn(q, df, 5), 0, [5, 12], 5).collect()}
    assert set(rows) == {5, 12}
    for length, r in rows.items():
        assert r.recall == 1 and r.graph_recall == plain[length].recall == plain[length].graph_recall < 1
        assert (r.mean_hops, r.mean_comparisons) == (plain[length].mean_hops, plain[length].mean_comparisons)


def test_taking_in_what_is_cut_off_makes_levels_of_the_whole_graph_once(spark, monkeypatch):
    x = np.arange(40, dtype=np.float64)[:, None] * np.ones(4)
    df = table_of(spark, x)
    # A path to 9; beyond it pairs that only lead to each other and to what follows, so that several rounds take them in.
    edges = [(i, i + 1) for i in range(9)] + [(i, i + 1) for i in range(10, 39, 2)] + [(i + 1, i) for i in range(10, 39, 2)]
    graph = spark.createDataFrame([(s, 0, d) for s, d in edges], "src bigint, pos int, dst bigint")
    levels, plain = [], G.bfs_levels
    monkeypatch.setattr(G, "bfs_levels", lambda *a, **k: levels.append(1) or plain(*a, **k))
    out = G.reached_from_least(graph, df, 3)
    assert len(levels) == 1
    assert plain(out, 0, 100).count() == 40 and out.groupBy("src").count().agg(F.max("count")).first()[0] <= 3


def test_probing_finds_by_either_row_what_the_other_misses(spark):
    n, params = 400, B.BuildParams(partitions=2, degree=6, length=6)  # short searches, which miss much
    x = points(n, seed=3)
    df = table_of(spark, x)
    local = B.local_graphs(B.partitioned(df, params), params)
    e = {(r.src, r.dst) for r in B.cross_edges(local, all_pairs(spark, 2), params).collect()}
    assert all((s < n // 2) != (d < n // 2) for s, d in e)
    near = lambda i, part: part[((x[part] - x[i]) ** 2).sum(axis=1).argmin()]
    low, high = np.arange(n // 2), np.arange(n // 2, n)
    wanted = [(int(i), int(near(i, high if i < n // 2 else low))) for i in range(n)]
    searched = {(r.src, r.dst) for r in once_probed(local, params)}
    share = lambda found: np.mean([w in found for w in wanted])
    assert share(e) > share(searched) + 0.05


def once_probed(local, params):
    """What single searches lead to: edges before those of the other way are added."""
    written, plain = [], B.stored
    B.stored = lambda t, name: written.append((name, plain(t, name))) or written[-1][1]
    try:
        B.cross_edges(local, all_pairs(local.sparkSession, 2), params).count()
    finally:
        B.stored = plain
    led = dict(written)["probed"]
    ids = local.select(F.col("part"), F.posexplode("ids").alias("at", "id"))
    name = lambda part, at, c: ids.select(F.col("part").alias(part), F.col("at").alias(at), F.col("id").alias(c))
    return led.join(name("i", "x", "src"), ["i", "x"]).join(name("j", "y", "dst"), ["j", "y"]).collect()


def test_a_sweep_with_a_check_tells_what_the_graphs_alone_find(spark):
    df, params = table_of(spark, points(600, seed=4)), B.BuildParams(partitions=2, degree=4, length=8)
    graphs, q = B.local_graphs(B.partitioned(df, params), params), df.filter("vec_id % 10 = 0")
    truth = knn(q, df, 5)
    both, alone = (S.sweep(q, graphs, truth, [5, 10], 5, beam=1, check=c).orderBy("length").collect() for c in (True, False))
    assert [r.recall for r in both] == [1, 1] and alone[0].recall < 1
    assert [r.graph_recall for r in both] == [r.recall for r in alone] == [r.graph_recall for r in alone]
    assert both[0].mean_comparisons < both[1].mean_comparisons
