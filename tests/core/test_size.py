"""What keeps large tables bounded: queries dealt to tasks, one graph for all codes, pruning without slack."""

import numpy as np
from pyspark.sql import functions as F
from test_whole import points, table_of

from orrery import catalogue_search as CS
from orrery.operators import kernels as N
from orrery.plans import build as B
from orrery.plans import search as S


def test_many_queries_are_dealt_to_several_tasks(spark, monkeypatch):
    df = table_of(spark, points(300))
    graphs = B.local_graphs(B.partitioned(df, B.BuildParams(partitions=2, degree=8)), B.BuildParams(partitions=2, degree=8))
    key = lambda found: sorted((r.qid, r["rank"], r.id, r.comparisons) for r in found.collect())
    whole = key(S.search_partitions(df, graphs, S.SearchParams(k=5, length=20)))
    monkeypatch.setattr(S, "ASKED", 64)
    assert [len(ids) for ids, _, _ in S.dealt(df, "vec_id", "embedding", [])] == [64, 64, 64, 64, 44]
    assert key(S.search_partitions(df, graphs, S.SearchParams(k=5, length=20))) == whole
    monkeypatch.setattr(S, "BLOCKS", 2)
    assert len(list(S.dealt(df, "vec_id", "embedding", []))) == 2


def test_codes_of_several_widths_share_one_graph(spark, monkeypatch, tmp_path):
    table_of(spark, points(200)).withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    built, plain = [], B.local_graphs
    monkeypatch.setattr(B, "local_graphs", lambda *a, **k: built.append(1) or plain(*a, **k))
    assert CS.rotated_bits_hits(spark, str(tmp_path)).count() == 4 * 4 and len(built) == 1


def test_pruning_without_slack_is_that_of_single_nodes():
    x = np.vstack([points(200), np.repeat(points(3, seed=2), 30, axis=0)])
    ids = np.random.default_rng(1).integers(-1, len(x), (len(x), 60))
    many = N.prune_many(np.arange(len(x)), ids.copy(), x, 7, 1.0)
    for p, own in enumerate(many):
        assert own[own >= 0].tolist() == N.robust_prune(p, ids[p][ids[p] >= 0], x, 7, 1.0)
