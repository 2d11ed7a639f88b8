"""Each stage of the pipeline works on what its predecessor kept."""

import corpus_pipeline as pipeline
from orrery.llm.shared import stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, sf), name)
        assert kept.columns == pipeline.COLUMNS
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in kept.collect()}
        assert after <= before
        if name == "quality_classifier":
            assert sum(labels[i].quality for i in before - after if i in labels) <= 2
        if name == "line_dedup":
            assert after == before
        docs = kept
    packed = stored(pipeline.STAGES[-1][1](spark, docs, sf), "packing")
    assert {r.doc_id for r in packed.collect()} == after
    assert packed.groupBy("doc_id").sum("length").join(packed.select("doc_id", "doc_tokens").distinct(), "doc_id").filter("`sum(length)` <> doc_tokens").count() == 0


ODD = [(1, None, None, None, None), (2, "", None, None, None), (None, "x", None, None, None), (2, "", None, None, None)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_odd_documents(spark, sf):
    docs = spark.createDataFrame([(*r, "clash") for r in ODD], f"{SCHEMA}, __digest string")
    stages = dict(pipeline.STAGES)
    for name, stage in pipeline.STAGES:
        assert stored(stage(spark, docs.limit(0), sf), name).count() == 0
    assert stages["quality_rules"](spark, docs, sf).count() == 0  # too few words
    cleaned = stages["line_dedup"](spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in cleaned) == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0)]
    # Texts without words are alike: the least id stays, with what repeats it.
    assert sorted((r.doc_id or 0, r.text) for r in stages["simhash_near_dedup"](spark, docs, sf).collect()) == [(0, "x"), (1, None)]
    same = spark.createDataFrame([ODD[1], ODD[1]], SCHEMA)
    assert stages["simhash_near_dedup"](spark, same, sf).count() == 2
    packed = stages["packing"](spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in packed) == [(0, 2), (1, 1), (2, 1), (2, 1)]


def test_near_duplicates_stage(spark, sf):
    words = [f"w{i}" for i in range(400)]
    near = " ".join([*words[:200], "other", *words[201:]])
    rows = [(5, " ".join(words)), (9, near), (3, " ".join(words)), (7, " ".join(words[:200])), (8, "w" + " ".join(words[::-1])), (None, " ".join(words))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = dict(pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf)
    assert kept.columns == pipeline.COLUMNS and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
    whole = pipeline.run(spark, sf)
    per = lambda d: sorted((r.doc_id, r.n) for r in d.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect())
    assert per(whole) == per(docs)
