"""Label sets of rows: predicates, numbering, statistics and synthetic labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_common(target: Column, query: Column) -> Column:
    """Some label in common; never for an empty query."""
    return (F.size(query) > 0) & F.arrays_overlap(target, query)


def has_all(target: Column, query: Column) -> Column:
    """All the query's labels; always for an empty query."""
    return F.size(F.array_except(query, target)) == 0


def has_label(target: Column, label, universal=None) -> Column:
    own = F.array_contains(target, label)
    return own if universal is None else own | F.array_contains(target, universal)


def within(attr: Column, low, high) -> Column:
    """Between both bounds; null never is."""
    return F.coalesce(attr.between(low, high), F.lit(False))


def number_labels(labels: DataFrame, universal: str | None = None) -> DataFrame:
    """(label, number) for labels (pos, label) in the order in which they first appear: from 1, or from 2 with a universal label, which is 0."""
    from orrery.operators.ranking import numbered

    first = labels.groupBy("label").agg(F.min("pos").alias("first"))
    own = numbered(first.filter(F.col("label") != universal) if universal is not None else first, "first", "label", column="n")
    out = own.select("label", (F.col("n") + (1 if universal is None else 2)).alias("number"))
    return out if universal is None else out.unionByName(first.filter(F.col("label") == universal).select("label", F.lit(0).cast("bigint").alias("number")))


def label_summary(rows: DataFrame, dense: int = 10, labels: str = "labels") -> DataFrame:
    """One row: rows, labels, the share of rows with at least `dense` labels, labels a row, and rows a label."""
    per_row = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg((F.size(labels) >= dense).cast("double")).alias("dense_share"), F.avg(F.size(labels)).alias("labels_per_row"))
    per_label = label_counts(rows, labels).agg(F.count(F.lit(1)).alias("n_labels"), F.avg("n_rows").alias("rows_per_label"))
    return per_row.crossJoin(per_label).select("n_rows", "n_labels", "dense_share", "labels_per_row", "rows_per_label")  # one row each


def label_percentiles(rows: DataFrame, shares: list[float], labels: str = "labels") -> DataFrame:
    """(share, label, n_rows): the label at floor(share * labels) in order of their rows, and of the label."""
    from orrery.operators.ranking import numbered

    ranked = numbered(label_counts(rows, labels), "n_rows", "label")
    n = ranked.count()
    at = rows.sparkSession.createDataFrame([(float(s), min(int(s * n), n - 1)) for s in shares], "share double, number bigint")
    return ranked.join(F.broadcast(at), "number").select("share", "label", "n_rows")


def common_labels(rows: DataFrame, n: int = 3, labels: str = "labels") -> DataFrame:
    return label_counts(rows, labels).orderBy(F.desc("n_rows"), "label").limit(n)


def label_medoids(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", labels: str = "labels") -> DataFrame:
    """(label, id): of the rows with a label the one nearest to their mean, ties to the lower id: where a search for it begins."""
    from orrery.functions.vectors import l2
    from orrery.operators.partitioning import centroids

    own = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.explode(labels).alias("label"))
    mean = centroids(own, "label", "vec").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("mean"))
    return own.join(mean, "label").groupBy("label").agg(F.min_by("id", F.struct(F.round(l2("vec", "mean"), 9), "id")).alias("id"))


def real_rows(found: DataFrame, copies: DataFrame, id_col: str = "id") -> DataFrame:
    """found with each copy's id replaced by its row's own; copies: (copy_id, real_id)."""
    own = found.join(copies.select(F.col("copy_id").alias(id_col), "real_id"), id_col, "left")
    return own.withColumn(id_col, F.coalesce("real_id", id_col)).drop("real_id")


def label_counts(rows: DataFrame, labels: str = "labels") -> DataFrame:
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


def break_dense(rows: DataFrame, id_col: str, density: int, labels: str = "labels") -> DataFrame:
    """(id, copy, labels): rows with more labels than density become copies with at most so many each; copy 0 is the row itself."""
    chunks = F.ceil(F.size(labels) / density).cast("int")
    piece = F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(chunks, F.lit(1)) - 1), lambda i: F.slice(F.col(labels), i * density + 1, F.lit(density)))).alias("copy", "labels")
    return rows.select(id_col, piece)


def synthetic(df: DataFrame, id_col: str, kind: str, n_labels: int, seed: int = 0) -> DataFrame:
    """(id, labels): random (each label with probability 1/2), zipf (label l with probability 0.7 / l) or one_per_point (0 to n_labels).

    Draws follow from the MD5 of seed, id and label, so they are the same wherever they are made.
    """
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    every = F.sequence(F.lit(1), F.lit(n_labels))
    found = {
        "random": lambda: F.filter(every, lambda i: draw(i) < 0.5),
        "zipf": lambda: F.filter(every, lambda i: draw(i) < F.lit(0.7) / i),
        "one_per_point": lambda: F.array((F.floor(draw(F.lit(0)) * (n_labels + 1))).cast("int")),
    }
    if kind not in found:
        raise ValueError(f"kind must be one of {tuple(found)}")
    labels = found[kind]()
    return df.select(id_col, F.when(F.size(labels) == 0, F.array(F.lit(0))).otherwise(labels).alias("labels"))
