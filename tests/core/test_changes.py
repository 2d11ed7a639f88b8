"""An index that changes, quantisers, shards, stages and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import brute, table, x  # noqa: F401  (fixtures)

from orrery.index import TieredIndex, VectorIndex, vector_search
from orrery.operators import convert as X
from orrery.operators import graph as G
from orrery.operators import kernels as N
from orrery.operators import partitioning as P
from orrery.operators import quantise as Q
from orrery.operators import recall as C
from orrery.operators.knn import knn
from orrery.operators.updates import window_steps
from orrery.plans import build as B
from orrery.plans import search as S
from orrery.sources.vector_files import VectorFiles, id_lines, label_lines, range_truth_rows, read_truth, truth_rows, write_range_truth, write_truth, write_truth_rows
from orrery.streaming import maintain as M

PARAMS = B.BuildParams(partitions=2, degree=16, length=40)


def ids_of(index, q, k=3, **more):
    return [r.id for r in index.search(q, S.SearchParams(k=k, length=40), **more).orderBy("rank").collect()]


# -- quantisers and shards ------------------------------------------------------------
def test_codebooks_are_saved(spark, table, x, tmp_path):
    book, own = Q.train(table, 4, centres=32), x.astype(np.float64)
    codes = book.encode(own)
    assert np.allclose(book.distances(own[7], codes), ((book.inflate(codes) - own[7]) ** 2).sum(1))
    assert np.allclose(book.products(own[7])[np.arange(4), codes].sum(1), -(book.inflate(codes) - book.centroid) @ own[7])
    book.save(spark, str(tmp_path / "book"))
    assert np.array_equal(Q.Codebook.load(spark, str(tmp_path / "book")).encode(own), codes)
    with pytest.raises(ValueError):
        Q.train(table, 4, centres=32, rotate=2).products(own[7])
    with pytest.raises(ValueError, match="don't go together"):
        Q.Codebook.from_json('{"pivots": [[1, 2]], "offsets": [0, 3], "centroid": [0, 0, 0], "rotation": null}')


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_rotated_bits(x, bits):
    own = x.astype(np.float64)
    q = Q.RotatedBits.of(own, bits, 4)
    codes = q.encode(own)
    assert codes.dtype == np.uint8 and codes.shape == (400, q.width) and q.width == bits * 8 + 17
    assert np.allclose(np.linalg.norm(q.turn(own), axis=1), np.linalg.norm(own, axis=1))
    again = Q.Quantiser.of_json(q.to_json())
    assert np.array_equal(again.encode(own), codes) and np.array_equal(again.stored(codes.tobytes(), 400), codes)
    for at in (3, 77):
        exact, guess = ((own - own[at]) ** 2).sum(1), q.distances(own[at], codes)
        assert np.corrcoef(exact, guess)[0, 1] > {1: 0.97, 4: 0.995, 8: 0.999}[bits]
        assert len(set(np.argsort(guess)[:40].tolist()) & set(brute(x, x[at], 10))) >= 9
    # Pairs are what single queries give, and products of bits what products of the codes' numbers give.
    asked, rows = q.prepare(own[:3]), np.repeat(np.arange(3), 400)
    assert np.allclose(q.pairs(asked, rows, np.vstack([codes] * 3)).reshape(3, 400), [q.distances(v, codes) for v in own[:3]])


def test_rotated_bits_are_unbiased(x):
    own = x.astype(np.float64)
    exact = ((own[:50, None] - own[None, 50:60]) ** 2).sum(2)
    guesses = []
    for seed in range(60):
        q = Q.RotatedBits.of(own, 1, 4, seed)
        asked = q.prepare(own[50:60])
        guesses.append(np.stack([q.pairs(asked, np.full(50, j), q.encode(own[:50])) for j in range(10)], axis=1))
    assert abs((np.mean(guesses, axis=0) - exact).mean()) < 0.02 * exact.mean()


def test_elkan_equals_lloyd(x):
    own = x.astype(np.float64)
    first = Q.kmeans_pp(own, 12, np.random.default_rng(3))
    assert np.allclose(Q.elkan(own, first, 12), Q.lloyd(own, first, 12))


def test_bounds_leave_distances_out(table, x):
    first = P.random_pivots(table, 12)
    want, residuals = P.kmeans(table, first, 8)
    got, own, asked = P.kmeans_by_bounds(table, first, 8)
    assert np.allclose(got, want) and np.allclose(own, residuals) and asked < 0.8 * 400 * 12 * len(own)


def test_seeds_are_as_good_as_those_of_one_machine(spark):
    rng = np.random.default_rng(2)
    means = rng.normal(size=(20, 6)) * 9
    own = np.concatenate([m + rng.normal(size=(n, 6)) * 0.3 for m, n in zip(means, rng.integers(5, 120, 20))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id bigint, embedding array<double>")
    residual = lambda c: ((own[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    driver = np.median([residual(Q.kmeans_pp(own, 20, np.random.default_rng(s))) for s in range(9)])
    found = [P.seeds(rows, 20, seed=s) for s in range(3)]
    assert all(f.shape == (20, 6) for f in found) and np.median([residual(f) for f in found]) <= driver
    assert np.array_equal(found[0], P.seeds(rows.repartition(7), 20, seed=0))
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(30)], "vec_id bigint, embedding array<double>")
    assert len(P.seeds(same, 2)) == 2


def test_kmeans_over_rows(table, x):
    first = P.random_pivots(table, 6)
    assert len(first) == 6 and np.array_equal(first, P.random_pivots(table.repartition(5), 6))
    centres, residuals = P.kmeans(table, first, 8)
    assert np.allclose(centres, Q.lloyd(x.astype(np.float64), first, 8)) and all(b <= a * (1 + 1e-9) for a, b in zip(residuals, residuals[1:]))
    found = {(r.id, r["rank"]): r.shard for r in P.kmeans_shards(table, centres, 2).collect()}
    d = ((x[:, None].astype(np.float64) - centres[None]) ** 2).sum(2)
    assert all(found[i, 0] == d[i].argmin() and found[i, 1] == d[i].argsort(kind="stable")[1] for i in range(400))
    for bad in (lambda: P.random_pivots(table.limit(3), 6), lambda: P.kmeans_shards(table, centres, 7)):
        with pytest.raises(ValueError):
            bad()


def test_shards_under_a_budget(table):
    with pytest.raises(ValueError, match="attempts"):
        P.budget_shards(table, P.index_bytes(20, 12), retries=2)
    assert P.largest_shard(64, P.index_bytes(5000, 64)) == 5000 and P.shards_needed(1000, 300, 2) == 7
    with pytest.raises(ValueError):
        P.shards_needed(10, 0, 2)


def test_points_on_a_sphere():
    p = N.sphere(200, 7, 3.0, seed=2)
    assert np.allclose(np.linalg.norm(p, axis=1), 3) and np.abs(p.mean(axis=0)).max() < 0.5


def test_clusters_lie_together(table):
    near = P.kmeans_shards(table, P.random_pivots(table, 4), 1).select("id", F.col("shard").alias("centre"))
    got = X.permuted(table, near).join(near.withColumnRenamed("id", "vec_id"), "vec_id").orderBy("location").collect()
    assert [r.location for r in got] == list(range(400)) and [r.centre for r in got] == sorted(r.centre for r in got)


def test_simulated_recall():
    assert C.simulated_recall([1.0] * 10, 10, 10, 1) == 1.0 and C.simulated_recall([0.5] * 10, 10, 10, 4) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        C.simulated_recall([1.0], 2, 2, 2)


# -- building ---------------------------------------------------------------------------
def test_stages_resume(spark, table, tmp_path):
    folder = str(tmp_path / "build")
    with pytest.raises(ValueError, match="not complete"):
        B.build_graph(table, PARAMS, stages=B.Stages(spark, folder, ["graph"]))
    B.Stages(spark, folder, ["local-graphs"]).table("local-graphs", lambda: B.local_graphs(B.partitioned(table, PARAMS), PARAMS))
    graph = B.build_graph(table, PARAMS, stages=B.Stages(spark, folder))
    again = B.build_graph(table, PARAMS, stages=B.Stages(spark, folder, []))  # read, not run
    assert graph.count() == again.count() > 400
    assert sorted(p.name for p in (tmp_path / "build").iterdir()) == sorted(B.STAGES)


def test_partitions_follow_from_memory_and_meet_their_nearest(table):
    params = B.BuildParams(memory=P.index_bytes(40, 12, degree=16) * 2 + 1, degree=16, length=30, near=3)
    assert params.count(400, 12) == 10
    local = B.local_graphs(B.partitioned(table, params), params)
    assert local.count() == 10 and 15 <= B.meeting(local, params).count() <= 30
    row = local.first().asDict()
    row["offsets"] = row["offsets"][:-1]
    with pytest.raises(ValueError, match="don't go together"):
        B.opened(row)


def test_graphs_are_checked(spark):
    good = spark.createDataFrame([(0, [1]), (1, [0]), (2, [0, 1])], "src long, nbrs array<long>")
    assert G.checked_graph(good, 3, 2)["edges"] == 4
    for n, degree in ((4, 2), (3, 1)):
        with pytest.raises(ValueError, match="not a graph"):
            G.checked_graph(good, n, degree)


def test_labels_stay_connected(x):
    labels = [{i % 5, 7} if i % 11 else {i % 5} for i in range(len(x))]
    g = N.Vamana(x, degree=8, length=30, labels=labels).build()
    for label, start in B.label_medoids(g).items():
        seen, front = {start}, [start]
        while front:
            new = [v for v in g.nbrs[front.pop()] if label in labels[v] and v not in seen]
            seen.update(new)
            front += new
        assert seen == {i for i, own in enumerate(labels) if label in own}


# -- an index that changes ----------------------------------------------------------------
def test_index_lives(spark, table, tmp_path):
    own = table.withColumn("vec_id", F.col("vec_id") + 1)
    at = lambda i: own.filter(F.col("vec_id") == i)
    index = VectorIndex.build(own.filter("vec_id <= 300"), PARAMS)
    assert ids_of(index, at(5))[0] == 5
    index, refused = index.insert(own.filter("vec_id BETWEEN 295 AND 320").unionByName(at(7).withColumn("vec_id", F.lit(0).cast("bigint"))))
    assert sorted(r.tag for r in refused.collect()) == [0, *range(295, 301)] and ids_of(index, at(310))[0] == 310
    assert index.graphs.select(F.explode("ids")).count() == 320
    index, failed = index.delete(spark.createDataFrame([(5,), (310,), (399,)], "tag long"))
    assert [r.tag for r in failed.collect()] == [399]
    index.save(str(tmp_path / "index"))
    index = VectorIndex.load(spark, str(tmp_path / "index"))
    after, report = index.consolidate()
    assert report.agg(F.sum("rows"), F.sum("released"), F.sum("active")).first() == (320, 2, 318)
    for i in (index, after, after.rebuild()):
        assert 5 not in ids_of(i, at(5), 10) and 310 not in ids_of(i, at(310), 10) and i.tags().count() == 318
    assert after.insert(at(5))[1].count() == 0 and index.insert(at(5))[1].count() == 1  # a tombstone keeps its tag until it is gone
    got = index.search(at(20), S.SearchParams(k=1, length=40), with_vectors=True).first()
    assert got.id == 20 and got.vec == at(20).first().embedding
    index.rows.limit(100).write.mode("overwrite").parquet(str(tmp_path / "fewer"))
    (tmp_path / "index/rows").rename(tmp_path / "all")
    (tmp_path / "fewer").rename(tmp_path / "index/rows")
    with pytest.raises(ValueError, match="was saved with"):
        VectorIndex.load(spark, str(tmp_path / "index"))


def test_index_checks_its_arguments(table):
    one = table.limit(1).withColumn("vec_id", F.lit(999).cast("bigint")).withColumn("embedding", F.slice("embedding", 1, 3))
    for bad in (lambda: VectorIndex.build(table.drop("embedding")), lambda: VectorIndex.build(table.withColumn("embedding", F.lit("x"))), lambda: VectorIndex.build(table, metric="hamming"),
                lambda: VectorIndex.build(table, metric="cosine", chunks=4), lambda: VectorIndex.build(table.unionByName(one), PARAMS), lambda: B.BuildParams(alpha=0.5), lambda: B.BuildParams(near=0),
                lambda: B.BuildParams(degree=True), lambda: B.check_fields(B.BuildParams(), '{"colour": 1}'), lambda: S.SearchParams(entries=-1), lambda: S.SearchParams(ratio=2)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="not 12 elements"):
        VectorIndex.build(table, PARAMS).insert(one)
    empty = VectorIndex.build(table.limit(0), PARAMS)
    assert empty.search(table.limit(2)).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        empty.insert(table)


def test_index_with_labels_predicates_and_codes(table):
    rows = table.withColumn("labels", F.when(F.col("vec_id") % 50 == 0, F.array("label", F.lit(9))).otherwise(F.array("label")))
    index = VectorIndex.build(rows, B.BuildParams(partitions=2, degree=24, length=60), labels="labels", chunks=4)
    q = rows.filter("vec_id % 80 = 1")
    found = index.search(q, S.SearchParams(k=5, length=60), label_col="label").collect()
    assert found and all(r.id % 3 == r.qid % 3 for r in found)
    found = index.search(q, S.SearchParams(k=100, length=400), label_col="label", universal=9).collect()
    assert any(r.id % 3 != r.qid % 3 for r in found) and all(r.id % 3 == r.qid % 3 or r.id % 50 == 0 for r in found)
    with pytest.raises(ValueError, match="no row has the labels"):
        index.search(q.withColumn("label", F.lit(77)), label_col="label")
    few = index.search(q, S.SearchParams(k=5, length=40), predicate=F.col("tag") % 10 == 3).collect()
    assert len(few) == 25 and all(r.id % 10 == 3 for r in few)
    index, _ = index.insert(rows.filter("vec_id = 5").withColumn("vec_id", F.lit(1000).cast("bigint")), labels="labels")
    assert 1000 in [r.id for r in index.search(rows.filter("vec_id = 5"), S.SearchParams(k=2, length=60), label_col="label").collect()]
    assert index.book is not None and index.graphs.filter("codes IS NULL").count() == 0


def test_tiers_merge(spark, table):
    own = table.withColumn("vec_id", F.col("vec_id") + 1)
    tiers = TieredIndex(VectorIndex.build(own.filter("vec_id <= 200"), PARAMS), most=60)
    tiers, refused = tiers.insert(own.filter("vec_id BETWEEN 195 AND 230"))
    assert refused.count() == 6 and tiers.small.rows.count() == 30
    assert tiers.search(own.filter("vec_id = 225"), S.SearchParams(k=1, length=30)).first().id == 225
    tiers = tiers.delete(spark.createDataFrame([(225,), (10,)], "tag long"))
    tiers, _ = tiers.insert(own.filter("vec_id BETWEEN 231 AND 290"))
    assert tiers.small is None and tiers.main.tags().count() == 288 and not {10, 225} & {r.tag for r in tiers.main.rows.collect()}


def test_vector_search_function(spark, table):
    index = VectorIndex.build(table, PARAMS)
    with pytest.raises(ValueError, match="use search"):
        vector_search(index, most=100)
    vector_search(index.delete(spark.createDataFrame([(7,)], "tag long"))[0], "near")
    table.filter("vec_id IN (7, 9)").createOrReplaceTempView("two")
    got = spark.sql("SELECT q.vec_id, r.* FROM two q, LATERAL near(q.embedding, 3, 40) r").collect()
    assert {r.vec_id: r.id for r in got if r["rank"] == 1}[9] == 9 and 7 not in {r.id for r in got} and len(got) == 6


def test_live_index_follows_a_stream(spark, table, tmp_path):
    own = table.select((F.col("vec_id") + 1).alias("tag"), F.col("embedding").alias("vec"))
    live = M.LiveIndex(VectorIndex.build(own.filter("tag <= 200"), PARAMS, "tag", "vec"), str(tmp_path / "live"))
    change = own.filter("tag BETWEEN 201 AND 220").selectExpr("'insert' AS op", "tag", "vec", "1L AS seq").unionByName(own.filter("tag <= 60").selectExpr("'delete' AS op", "tag", "vec", "1L AS seq"))
    change.write.parquet(str(tmp_path / "changes"))
    live.follow(spark.readStream.schema(change.schema).parquet(str(tmp_path / "changes")), str(tmp_path / "checkpoint")).awaitTermination()
    index = live.read(0)
    assert sorted(r.tag for r in index.tags().collect()) == list(range(61, 221)) and index.dead.count() == 0 and index.rows.count() == 160


def test_live_table_rewrites_what_a_batch_touches(spark, tmp_path):
    live = M.LiveTable(spark, str(tmp_path / "t"), buckets=4)
    rows = lambda op, tags, seq: spark.createDataFrame([(op, t, [float(seq)], seq) for t in tags], "op string, tag bigint, vec array<float>, seq bigint")
    live.apply(rows("insert", range(40), 1), 0)
    live.apply(rows("delete", [3], 2), 1)
    assert len(list((tmp_path / "t/v00000001").glob("bucket=*"))) == 1
    assert sorted(r.tag for r in live.read(1).collect()) == [t for t in range(40) if t != 3] and live.read(0).count() == 40
    live.apply(rows("delete", range(40), 3), 2)
    assert live.read(2).count() == 0


def test_window_steps():
    steps = window_steps(500, 200, 100)
    assert [i for i, _ in steps] == [(0, 100), (100, 200), (200, 300), (300, 400), (400, 500)] and [d for _, d in steps] == [(0, 0), (0, 0), (0, 100), (100, 200), (200, 300)]
    with pytest.raises(ValueError):
        window_steps(10, 5, 6)


# -- files ------------------------------------------------------------------------------------
@pytest.mark.parametrize("layout", ["bin", "vecs"])
def test_vector_files(spark, table, x, tmp_path, layout):
    spark.dataSource.register(VectorFiles)
    folder = str(tmp_path / layout)
    own = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    write = lambda df, mode: df.write.format("vectors").option("layout", layout).mode(mode).save(folder)
    read = lambda **options: spark.read.format("vectors").option("layout", layout).options(**options)
    write(own.repartitionByRange(3, "id").sortWithinPartitions("id"), "append")
    assert len(list((tmp_path / layout).iterdir())) == 3
    got = read().load(folder).orderBy("id").collect()  # a folder of files
    assert [r.id for r in got] == list(range(400)) and np.array_equal(np.array([r.vec for r in got], np.float32), x)
    assert [r.id for r in read(first=150, end=290).load(folder).orderBy("id").collect()] == list(range(150, 290))
    write(own.coalesce(1).sortWithinPartitions("id"), "overwrite")
    file, = (tmp_path / layout).iterdir()
    got = read().load(str(file)).orderBy("id").collect()
    assert np.array_equal(np.array([r.vec for r in got], np.float32), x)
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(Exception, match="under its header"):
        read().load(str(file)).count()


def test_truth_files(spark, table, tmp_path):
    ids, dist = np.arange(6).reshape(2, 3), np.arange(6, dtype=np.float32).reshape(2, 3)
    write_truth(str(tmp_path / "t"), ids, dist)
    a, b = read_truth(str(tmp_path / "t"))
    assert np.array_equal(a, ids) and np.array_equal(b, dist)
    asked = table.filter("vec_id < 5")
    truth = knn(asked, table, 4)
    write_truth_rows(truth, str(tmp_path / "rows"))
    back = truth_rows(spark, str(tmp_path / "rows"))
    assert back.join(truth.select("qid", "id", "rank"), ["qid", "id", "rank"]).count() == 20 == back.count()
    within = knn(asked, table, 0, radius=0.6)
    write_range_truth(within, asked.select(F.col("vec_id").alias("qid")), str(tmp_path / "range"))
    lists = {r.qid: r.ids for r in range_truth_rows(spark, str(tmp_path / "range")).collect()}
    assert lists == {q: [r.id for r in within.filter(F.col("qid") == q).orderBy("dist", "id").collect()] for q in range(5)}
    with pytest.raises(ValueError):
        write_truth_rows(truth.filter("NOT (qid = 1 AND rank = 4)"), str(tmp_path / "bad"))


def test_text_lists(spark):
    lines = spark.createDataFrame([("7",), ("# none",), ("",), (" 12 # two",)], "value string")
    assert sorted(r.id for r in id_lines(lines).collect()) == [7, 12]
    with pytest.raises(Exception, match="not a node"):
        id_lines(spark.createDataFrame([("x",)], "value string")).collect()
    got = {r.pos: r.labels for r in label_lines(spark.createDataFrame([(0, "a, b"), (1, ""), (2, "c,")], "pos int, value string")).collect()}
    assert got == {0: ["a", "b"], 1: [], 2: ["c"]}
