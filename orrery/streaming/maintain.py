"""A live table, and a live index, of vectors kept up to date by a stream of inserts and deletes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.index import VectorIndex
from orrery.operators.updates import after_deletes, upsert, window_steps


class LiveTable:
    """Versions of a table (tag, vec, seq) under one folder; each batch of the stream writes the next.

    Rows are dealt to `buckets` folders by a hash of the tag, and a version has the buckets that its batch touches alone; the
    others are read where they were written last. So a batch rewrites what it touches.

    A version is complete when its folder is, and a batch that runs again writes
    the same version again, so a lost driver or executor leaves no half state.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str = "tag bigint, vec array<float>, seq bigint", buckets: int = 16):
        self.spark, self.folder, self.schema, self.buckets = spark, folder, schema, buckets

    def _at(self, version: int) -> str:
        return f"{self.folder}/v{version:08d}"

    def _buckets(self, version: int) -> dict[int, str]:
        """Where each bucket lies as of a version: its newest folder."""
        found: dict[int, str] = {}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for v in range(version + 1):
            path = jvm.org.apache.hadoop.fs.Path(self._at(v))
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                for f in fs.listStatus(path):
                    name = f.getPath().getName()
                    if name.startswith("bucket="):
                        found[int(name[7:])] = f.getPath().toString()
        return found

    def read(self, version: int, buckets: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(self._buckets(version).items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).filter("tag IS NOT NULL")

    def apply(self, batch: DataFrame, number: int) -> None:
        """One batch of rows (op, tag, vec, seq); op is insert or delete, and the last of a tag in order of seq counts."""
        bucket = F.pmod(F.xxhash64("tag"), F.lit(self.buckets))
        last = batch.groupBy("tag").agg(F.max_by(F.struct("op", "vec", "seq"), "seq").alias("r")).select("tag", "r.*")
        touched = [r[0] for r in last.select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
        live = after_deletes(self.read(number - 1, touched), last.filter("op = 'delete'"))
        live = upsert(live, last.filter("op = 'insert'").select("tag", "vec", "seq")).withColumn("bucket", bucket)
        # A bucket that a batch empties is written too, as a row that says nothing.
        empty = self.spark.createDataFrame([(b,) for b in touched], "bucket bigint").select(F.lit(None).cast("bigint").alias("tag"), F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast("bigint").alias("seq"), "bucket")
        live.select("tag", "vec", "seq", "bucket").unionByName(empty).write.mode("overwrite").partitionBy("bucket").parquet(self._at(number))

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LiveIndex:
    """An index that follows a stream of (op, tag, vec, seq): inserts enter the graphs, deletes become tombstones, and these are
    consolidated when they are over a share of the rows. Each batch notes a version, which shares with the one before all partitions
    that the batch didn't touch."""

    def __init__(self, index: VectorIndex, folder: str, share: float = 0.2):
        self.folder, self.share, self.spark = folder, share, index.spark
        index.kept_under(folder).note(f"{folder}/v-start")

    def read(self, version: int | None = None) -> VectorIndex:
        return VectorIndex.noted(self.spark, f"{self.folder}/v-start" if version is None or version < 0 else f"{self.folder}/v{version:08d}")[0]

    def apply(self, batch: DataFrame, number: int) -> None:
        last = batch.groupBy("tag").agg(F.max_by(F.struct("op", "vec", "seq"), "seq").alias("r")).select("tag", "r.*")
        index, _ = self.read(number - 1).delete(last.filter("op = 'delete'").select("tag"))
        if index.dead.count() > self.share * index.rows.count():
            index, _ = index.consolidate()
        index, _ = index.insert(last.filter("op = 'insert'"), "tag", "vec")
        index.note(f"{self.folder}/v{number:08d}")

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding_window(index: VectorIndex, rows: DataFrame, width: int, interval: int, first: int, total: int, id_col: str = "vec_id", vec_col: str = "embedding") -> Iterator[VectorIndex]:
    """The index after each step of a window over rows in order of id: `interval` rows in, the oldest beyond `width` out, consolidated.
    The index holds rows 0 to first - 1 at the beginning."""
    for (a, b), (c, d) in window_steps(total, width, interval):
        if b > first:
            index, _ = index.insert(rows.filter(F.col(id_col).between(max(a, first), b - 1)), id_col, vec_col)
        if d > c:
            index, _ = index.delete(rows.filter(F.col(id_col).between(c, d - 1)).select(F.col(id_col).alias("tag")))
            index, _ = index.consolidate()
        yield index
