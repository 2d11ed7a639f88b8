"""From raw documents to packed sequences: five stages, each by one operator.

Every stage but the last returns the columns of documents. ORACLE_SQL is None:
fits and fingerprints have no SQL form; tests hold each stage against plain code.

Defined results: a null text counts as empty, is scored like any other, has no
words and so ends at the quality rules; rows with a null id pass like others, but
for near-duplicates, where no null id stays before another; repeated rows (one id,
one text) go or stay together; other columns than those of documents are left
out; line dedup makes a null text empty and counts n_chars anew, else values stay
as they are; of documents that are alike the least id stays; texts of any length are taken whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import line_dedup, packing, quality_classifier, quality_rules, simhash
from orrery.llm.queries import vocabulary_path
from orrery.llm.shared import discard, stored
from orrery.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is at least the threshold go on."""
    ship(spark)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model, COLUMNS, out="__score").filter(F.col("__score") >= quality_classifier.THRESHOLD).select(COLUMNS)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are probably good go on."""
    ship(spark)
    return quality_rules.judge(docs, COLUMNS).filter("kept").select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go; every document stays."""
    ship(spark)
    cleaned = line_dedup.LineIndex(spark).insert(docs).clean(docs.select(COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, 0.8) the one with the least doc_id stays."""
    ship(spark)
    stays = simhash.near_duplicates(docs).filter("stays").select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__id"))
    own = docs.select(COLUMNS).withColumn("__digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    # By the id too, so that copies of one text don't meet in one task.
    return own.join(stays, own["__digest"].eqNullSafe(stays["__digest"]) & F.col("doc_id").eqNullSafe(F.col("__id"))).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, with the pieces' ids."""
    ship(spark)
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
