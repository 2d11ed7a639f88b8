"""An index whose merges go on beside changes: two sets of deletes and a journal.

Changes are rows (op, tag, vec, seq) in a journal, a table by number; a search sees
them at once: tags that the journal changes are tombstones, and what it inserts is
searched exactly. A merge freezes the journal's present end, and works on what is
before it: the frozen deletes leave the graphs, the frozen inserts enter them. What
comes meanwhile has higher numbers, and stays in the journal. The swap is one note
of the new version with the number up to which the journal is in it; changes
beyond are replayed onto it by being read again. A merge that dies leaves files
that no note names, and the next one begins anew from the last note.

Defined results: of several changes of a tag the one of the highest journal
number, and in it of the highest seq, counts; an insert of a tag that is there
takes its place; a batch that is written again under its number takes its own
place; rows without a tag count for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.index import VectorIndex
from orrery.operators.knn import knn, merge_top_k
from orrery.plans.search import SearchParams

CHANGES = "op string, tag bigint, vec array<float>, seq bigint"


class DurableIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def create(cls, index: VectorIndex, folder: str) -> DurableIndex:
        index.kept_under(folder).note(f"{folder}/version-00000000", upto=-1)
        return cls(index.spark, folder)

    # -- what there is ---------------------------------------------------------
    def _numbers(self, kind: str) -> list[int]:
        """Of the complete tables of a kind: versions and journal batches since the last merges."""
        top = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = "note/_SUCCESS" if kind == "version" else "_SUCCESS"
        found = fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}-*/{done}"))
        return sorted(int(s.getPath().toString().removesuffix(f"/{done}").rpartition("-")[2]) for s in found or [])

    def version(self) -> tuple[VectorIndex, dict]:
        return VectorIndex.noted(self.spark, f"{self.folder}/version-{self._numbers('version')[-1]:08d}")

    def journal(self, after: int, upto: int | None = None) -> DataFrame:
        """(op, tag, vec): the last change of each tag in the batches with numbers in (after, upto]."""
        batches = [n for n in self._numbers("journal") if n > after and (upto is None or n <= upto)]
        rows = None
        for n in batches:
            own = self.spark.read.schema(CHANGES).parquet(f"{self.folder}/journal-{n:08d}").filter("tag IS NOT NULL").withColumn("number", F.lit(n))
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return self.spark.createDataFrame([], "op string, tag bigint, vec array<float>")
        last = rows.groupBy("tag").agg(F.max_by(F.struct("op", "vec"), F.struct("number", "seq")).alias("r"))
        return last.select("r.op", "tag", "r.vec")

    # -- changes -----------------------------------------------------------------
    def apply(self, batch: DataFrame, number: int) -> None:
        batch.select("op", "tag", "vec", F.col("seq").cast("bigint").alias("seq")).write.mode("overwrite").parquet(f"{self.folder}/journal-{number:08d}")

    def freeze(self) -> int:
        """The journal's end as it is now: what a merge will take in."""
        return max(self._numbers("journal"), default=-1)

    def merge(self, frozen: int | None = None) -> VectorIndex:
        """Takes the journal up to `frozen` into the graphs, and swaps. Changes may come at any time meanwhile."""
        frozen = self.freeze() if frozen is None else frozen
        index, meta = self.version()
        if frozen <= meta["upto"]:
            return index
        changes = self.journal(meta["upto"], frozen)
        index = index.delete(changes.select("tag"))[0].consolidate()[0]
        inserts = changes.filter("op = 'insert'").select("tag", "vec")
        if index.sizes:
            index = index.insert(inserts, "tag", "vec")[0]
        elif not inserts.isEmpty():
            index = VectorIndex.build(inserts, index.params, "tag", "vec", metric=index.params.metric).kept_under(self.folder)
        index.note(f"{self.folder}/version-{self._numbers('version')[-1] + 1:08d}", upto=frozen)
        return index

    # -- reading -------------------------------------------------------------------
    def search(self, queries: DataFrame, params: SearchParams = SearchParams(), tag_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(qid, id, dist, rank): of the last version and of what the journal has beyond it."""
        index, meta = self.version()
        changes = self.journal(meta["upto"])
        hidden = index.delete(changes.select("tag"))[0]
        own = hidden.search(queries, params, tag_col, vec_col).select("qid", "id", "dist")
        new = changes.filter("op = 'insert'").select(F.col("tag").alias(tag_col), F.col("vec").alias(vec_col))
        more = knn(queries, new, params.k, index.params.metric, id_col=tag_col, vec_col=vec_col).select("qid", "id", "dist")
        return merge_top_k(own.unionByName(more), params.k)

    def tags(self) -> DataFrame:
        index, meta = self.version()
        changes = self.journal(meta["upto"])
        return index.tags().join(changes, "tag", "left_anti").select("tag").unionByName(changes.filter("op = 'insert'").select("tag"))
