"""Conversions of vector tables: element types, text forms, subsets, tags and generated data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = {"int8": ("tinyint", -128, 127), "uint8": ("smallint", 0, 255), "int32": ("int", -(2**31), 2**31 - 1)}


def to_integers(vec, dtype: str, scale: float = 1.0) -> Column:
    """Elements times scale, rounded down and kept within the type's range."""
    if dtype not in ELEMENTS:
        raise ValueError(f"dtype must be one of {tuple(ELEMENTS)}")
    kind, low, high = ELEMENTS[dtype]
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(v, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), F.floor(x.cast("double") * scale))).cast(kind))


def to_floats(vec, scale: float = 1.0) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(v, lambda x: (x.cast("double") * scale).cast("float"))


def to_tsv(vec) -> Column:
    return F.array_join(F.transform(F.col(vec), lambda x: x.cast("string")), "\t")


def from_tsv(line: str, dim: int) -> Column:
    """Raises on a line with another number of elements or one that is no number."""
    parts = F.split(line, "\t")
    wrong = F.raise_error(F.concat(F.lit(f"not {dim} elements: "), F.substring(line, 1, 60)))
    return F.when(F.size(parts) == dim, F.transform(parts, lambda x: x.cast("float"))).otherwise(wrong)


def first_rows(df: DataFrame, n: int, id_col: str = "vec_id") -> DataFrame:
    return df.filter(F.col(id_col) < n)


def with_tags(df: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return df.withColumn("tag", F.col(id_col))


def hashed_vectors(df: DataFrame, dim: int, norm: float, id_col: str = "vec_id", seed: int = 0) -> DataFrame:
    """(vec_id, embedding array<double>): a random direction for each id, times a norm. Normal numbers come from the MD5 of seed, id and
    dimension (Box-Muller), so that they are the same wherever they are made."""
    part = lambda j, at: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), j.cast("string"))), at, 8), 16, 10).cast("double") + 0.5) / 2**32
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.sqrt(-2 * F.log(part(j, 1))) * F.cos(2 * F.pi() * part(j, 9)))
    own = df.select(id_col, x.alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return own.select(id_col, F.transform("x", lambda v: v / length * norm).alias("embedding"))


def perturbed(base: DataFrame, n: int, spread: float, step: int = 37, seed: int = 0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding): n queries, each a row of base (the step-th after the one before) moved by normal noise of that spread."""
    total = base.count()
    rows = base.sparkSession.range(n).select(F.col("id").alias("__q"), F.pmod(F.col("id") * step, F.lit(total)).alias(id_col))
    own = base.join(rows, id_col).select(F.col("__q").alias(id_col), vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            moved = [(np.array(v) + np.random.default_rng([seed, i]).normal(scale=spread, size=len(v))).astype(np.float32) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(moved, pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    return own.mapInArrow(run, "vec_id bigint, embedding array<float>")


def permuted(df: DataFrame, assigned: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """df with a dense number location in the order of its rows' clusters (assigned: id, centre), so that near rows lie together."""
    from orrery.operators.ranking import numbered

    order = numbered(assigned.select("centre", F.col("id").alias(id_col)), "centre", id_col, column="location")
    return df.join(order.select(id_col, "location"), id_col)


def clustered(spark: SparkSession, n: int, dim: int, clusters: int = 16, spread: float = 0.045, seed: int = 1, partitions: int = 8) -> DataFrame:
    """(vec_id, embedding): n points around seeded centres; a row depends on its id and the seed alone."""
    middle = np.random.default_rng(seed).normal(size=(clusters, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                rows.append((middle[i % clusters] + rng.normal(scale=spread, size=dim)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    return spark.range(0, n, 1, partitions).mapInArrow(run, "vec_id bigint, embedding array<float>")
