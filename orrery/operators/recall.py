"""Recall, truth sets and statistics of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_with_ties(truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """(qid, hits, recall): the truth's prefix of k goes on while distances equal the k-th. Recall is a fraction of k."""
    kth = F.max(F.when(F.col("rank") <= k, F.col("dist"))).over(Window.partitionBy("qid"))
    extended = truth.withColumn("kth", kth).filter((F.col("rank") <= k) | (F.col("dist") == F.col("kth"))).select("qid", "id")
    hits = extended.join(result.filter(F.col("rank") <= k).select("qid", "id").distinct(), ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return truth.select("qid").distinct().join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / k).alias("recall"))


def range_recall(truth: DataFrame, result: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, recall): the share of the truth that was found; 1 for an empty truth."""
    found = truth.select("qid", "id").join(result.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    per = found.groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return queries.select("qid").join(per, "qid", "left").select("qid", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def prune_to_range(truth: DataFrame, radius: float) -> DataFrame:
    return truth.filter(F.col("dist") <= radius)


def window_truth(truth: DataFrame, starts: DataFrame, width: int, k: int) -> DataFrame:
    """For each step (step, first): the first k of a long truth list whose ids lie in [first, first + width)."""
    inside = truth.join(F.broadcast(starts), (F.col("id") >= F.col("first")) & (F.col("id") < F.col("first") + width))
    rank = F.row_number().over(Window.partitionBy("step", "qid").orderBy("dist", "id"))
    return inside.withColumn("rank", rank).filter(F.col("rank") <= k).select("step", "qid", "rank", "id", "dist")


def truth_of_windows(queries: DataFrame, base: DataFrame, starts: list[tuple[int, int]], width: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(step, qid, rank, id, dist): the k nearest of all rows of each window (step, first), those with ids in [first, first + width). A scan for each window, of its rows."""
    from orrery.operators.knn import knn

    out = None
    for step, first in starts:
        own = knn(queries, base.filter((F.col(id_col) >= first) & (F.col(id_col) < first + width)), k, id_col=id_col, vec_col=vec_col)
        row = own.select(F.lit(step).cast("bigint").alias("step"), "qid", "rank", "id", "dist")
        out = row if out is None else out.unionByName(row)
    return out


def plain_recall(truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """(qid, hits, recall): hits among the first k of both, without regard to ties; a fraction of k."""
    hits = truth.filter(F.col("rank") <= k).select("qid", "id").join(result.filter(F.col("rank") <= k).select("qid", "id").distinct(), ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return truth.select("qid").distinct().join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / k).alias("recall"))


def live_recall(truth: DataFrame, result: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """plain_recall() against the k first of a long truth list that are live (live: id)."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("qid").orderBy("dist", "id"))
    return plain_recall(truth.join(live.select("id"), "id", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= k), result, k)


def simulated_recall(recalls: list[float], k: int, wanted: int, parts: int, rounds: int = 1000, seed: int = 1) -> float:
    """The recall at `wanted` to expect of `parts` shards that return k each, if neighbours lie anywhere: recalls[j - 1] is a shard's at j.

    Drawn with a seed. A shard in which more than k lie finds those that its recall at k leaves of k.
    """
    import numpy as np

    if len(recalls) < k or k < 1 or parts < 1:
        raise ValueError("recalls must go to k, and k and parts must be positive")
    count = np.random.default_rng(seed).multinomial(wanted, [1 / parts] * parts, size=rounds)
    most = np.minimum(count, k)
    found = np.where(most > 0, np.array([0.0, *recalls])[most] * most, 0.0)
    return float(found.sum(axis=1).mean() / wanted)
