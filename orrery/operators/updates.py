"""Insertions and deletions on index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.ranking import numbered
from orrery.storage import stored


def upsert(live: DataFrame, new: DataFrame, key: str = "tag", order: str = "seq") -> DataFrame:
    """live with the new rows; of several rows of one key the last in order stays, and new rows replace live ones."""
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")
    return live.join(last, key, "left_anti").unionByName(last)


def insert_new(live: DataFrame, new: DataFrame, key: str = "tag") -> tuple[DataFrame, DataFrame]:
    """(live with those rows that it lacks, rows refused: a tag that is there already, or 0, which is reserved)."""
    taken = (F.col(key) == 0)
    fresh = new.filter(~taken).join(live.select(key), key, "left_anti")
    refused = new.filter(taken).select(key).unionByName(new.filter(~taken).join(live.select(key), key, "left_semi").select(key))
    return live.unionByName(fresh), refused


def failed_deletes(live: DataFrame, asked: DataFrame, key: str = "tag") -> DataFrame:
    return asked.join(live, key, "left_anti").select(key)


def after_deletes(live: DataFrame, tombstones: DataFrame, key: str = "tag") -> DataFrame:
    return live.join(tombstones.select(key), key, "left_anti")


def consolidate_expand(edges: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(src, dst) of live sources: live neighbours, and for each deleted neighbour its live neighbours; as sets, without self loops.

    tombstones: (id). Lists longer than the degree are then pruned as after any change.
    """
    dead = tombstones.select("id").distinct()
    own = edges.select("src", "dst").distinct().join(dead, F.col("src") == F.col("id"), "left_anti")
    kept = own.join(dead, F.col("dst") == F.col("id"), "left_anti")
    through = own.join(dead, F.col("dst") == F.col("id"), "left_semi").withColumnRenamed("dst", "via")
    second = edges.select(F.col("src").alias("via"), "dst").distinct().join(dead, F.col("dst") == F.col("id"), "left_anti")
    return kept.unionByName(through.join(second, "via").select("src", "dst")).filter("src <> dst").distinct()


def compact_ids(live: DataFrame, key: str) -> DataFrame:
    """(key, location): dense numbers in the order of the key."""
    return numbered(live.select(key), key, column="location")


def delete_merge(edges: DataFrame, tombstones: DataFrame, sampled: int) -> DataFrame:
    """(src, dst) of live sources: consolidate_expand(), in which a deleted neighbour gives at most its first `sampled` live ones.

    edges: (src, pos, dst), positions in order of distance.
    """
    dead = tombstones.select("id").distinct()
    unique = edges.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    own = unique.join(dead, F.col("src") == F.col("id"), "left_anti")
    kept = own.join(dead, F.col("dst") == F.col("id"), "left_anti").select("src", "dst")
    through = own.join(dead, F.col("dst") == F.col("id"), "left_semi").select("src", F.col("dst").alias("via"))
    live = unique.join(dead, F.col("src") == F.col("id"), "left_semi").join(dead, F.col("dst") == F.col("id"), "left_anti")
    first = live.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("pos", "dst"))).filter(F.col("n") <= sampled).select(F.col("src").alias("via"), "dst")
    return kept.unionByName(through.join(first, "via").select("src", "dst")).filter("src <> dst").distinct()


def delete_merge_on_codes(edges: DataFrame, tombstones: DataFrame, vectors: DataFrame, book, degree: int, sampled: int, entry: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int | None]:
    """(src, dst) of the live rows under dense numbers, and the entry's new number: delete_merge(), whose lists of over `degree` are

    pruned by code distances, so that no vectors move. Lists that are short enough stay as they are. The entry, if it is deleted, gives way as in entry_after_deletes().
    """
    from orrery.operators.graph import occlusion_prune_codes

    merged = stored(delete_merge(edges, tombstones, sampled), "merged-lists")
    long = stored(merged.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > degree).select("src"), "long-lists")
    pruned = occlusion_prune_codes(merged.join(long, "src", "left_semi"), vectors, book, degree, 1, id_col, vec_col).select("src", "dst")
    lists = merged.join(long, "src", "left_anti").unionByName(pruned)
    numbers = compact_ids(after_deletes(vectors.select(id_col), tombstones.select(F.col("id").alias(id_col)), id_col), id_col)
    at = entry_after_deletes(edges, tombstones, entry)
    place = None if at is None else numbers.filter(F.col(id_col) == at).first()
    return renumbered(lists, numbers, id_col), None if place is None else place["location"]


def entry_after_deletes(edges: DataFrame, tombstones: DataFrame, entry: int) -> int:
    """The entry, or if it is deleted its first live neighbour by position; of none, the least live source."""
    dead = tombstones.select("id").distinct()
    if not dead.filter(F.col("id") == entry).limit(1).count():
        return entry
    live = edges.join(dead, F.col("dst") == F.col("id"), "left_anti").filter(F.col("src") == entry).orderBy("pos", "dst").select("dst").first()
    return live[0] if live else edges.join(dead, F.col("src") == F.col("id"), "left_anti").agg(F.min("src")).first()[0]


def renumbered(edges: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """(src, dst) under the dense numbers of compact_ids(); edges at nodes without a number go."""
    name = lambda c: numbers.select(F.col(key).alias(c), F.col("location").alias(f"new_{c}"))
    return edges.select("src", "dst").join(name("src"), "src").join(name("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def window_steps(total: int, width: int, interval: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """The steps of a sliding window over rows 0..total-1: ranges to insert and then to delete, `interval` rows at a time, so that at
    most width rows are live after a step."""
    if not 0 < interval <= width:
        raise ValueError("the interval must be positive and at most the width")
    steps, first = [], 0
    for begin in range(0, total, interval):
        end = min(begin + interval, total)
        gone = max(0, end - width)
        steps.append(((begin, end), (first, max(first, gone))))
        first = max(first, gone)
    return steps
