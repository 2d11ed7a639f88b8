"""Row numbers and order statistics over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.storage import stored


def numbered(df: DataFrame, *order: str, column: str = "number", within: list[str] | None = None) -> DataFrame:
    """df with its row numbers, from 0, in the order of the given columns, which should order rows fully with those of within.

    Rows are dealt by ranges (of order alone, for columns that are too long for it) and sorted within them; the sizes of the ranges,
    one row for each, give the numbers at which they begin.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order, *(within or []))
    place = stored(sorted_.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("__at", 33)
    sizes = [(r.part, r.n) for r in place.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()]
    first, starts = 0, []
    for p, n in sizes:
        starts.append((p, first))
        first += n
    begin = df.sparkSession.createDataFrame(starts, "__part bigint, __first bigint")  # one row for each partition
    joined = place.join(F.broadcast(begin), part == F.col("__part"))
    return joined.withColumn(column, F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__first")


def percentiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, value): the element at floor(share * n) of the sorted values, without interpolation."""
    ranked = numbered(df.select(F.col(value).alias("value")).filter("value IS NOT NULL"), "value")
    n = ranked.count()
    at = df.sparkSession.createDataFrame([(float(s), min(int(s * n), n - 1)) for s in shares], "share double, number bigint")
    return ranked.join(F.broadcast(at), "number").select("share", "value")
