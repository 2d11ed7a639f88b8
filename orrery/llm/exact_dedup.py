"""Exact dedup through a persistent digest index (operator 8, native).

The index is a Parquet table bucketed and sorted by the text's SHA-256. A batch
is reduced to one row for each digest before anything else moves, compared with
the index by a sort-merge anti-join, and what is new is appended. The index side
is not shuffled; each bucket is sorted again while it is read, as Spark takes no
order from files (several appends leave several files of a bucket). Rows of a hot
digest are answered without a shuffle.

Defined results: a null text counts as empty; rows that repeat a document id
with the same text are one document and stay or go together; a null id never
wins over another id; equal ids are one; texts of any length are hashed whole and
not moved, but must fit a row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import discard, remove, scratch, shuffle_partitions, stored

#: A digest with over 1 / HOT of a batch's rows is hot.
HOT = 1000
INDEX_SCHEMA = "digest binary, keep_id bigint, group_size bigint"


class DigestIndex:
    """A table of digests seen so far, with the document that stays for each."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None, table: str | None = None):
        self.spark = spark
        self.buckets = buckets or shuffle_partitions(spark)
        self.location = location or scratch(spark, "digest-index")
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        # An existing location is opened again; bucketing is declared, not inferred.
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def frame(self) -> DataFrame:
        """The index with its bucketing."""
        return self.spark.table(self.table)

    def plain(self) -> DataFrame:
        """The same rows without the bucketing, for joins that must be free to split a hot digest."""
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.location)

    def drop(self) -> None:
        """Delete the index, its files included."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.location)

    def append_new(self, groups: DataFrame) -> None:
        """Add the digests that the index lacks. groups: (digest, keep_id, group_size), one row each."""
        fresh = groups.hint("merge").join(self.frame().select("digest"), "digest", "left_anti")
        (fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .mode("append").option("path", self.location).saveAsTable(self.table))
        self.spark.catalog.refreshTable(self.table)


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    With an index of earlier batches, a text that it holds keeps the document
    that was stored first, and rows of this batch with that text are dropped.
    group_size is the size of the group in the batch that stored it. Without an
    index the batch has one of its own, which is deleted when it has answered.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    digests = stored(with_digest(docs, id_col, text_col), "digests")
    groups = stored(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    index.append_new(groups)
    # A digest with more than 1 / HOT of the rows is hot. Fewer than HOT can be, so they go to all tasks; their rows don't move.
    hot = groups.filter(F.col("group_size") * HOT > digests.count()).select("digest")
    known = index.plain()
    of_hot = F.broadcast(known.join(F.broadcast(hot), "digest"))
    of_rest = known.join(F.broadcast(hot), "digest", "left_anti")
    rest = digests.join(F.broadcast(hot), "digest", "left_anti")
    joined = digests.join(of_hot, "digest").unionByName(rest.join(of_rest, "digest"))  # reads digests, groups and the index
    out = joined.select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    if own:  # an index for this batch alone is not kept
        out = stored(out, "exact-dedup")
        index.drop()
        discard(digests, groups)
    return out
