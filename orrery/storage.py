"""Tables in storage that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the storage that the driver and all executors share.

    spark.checkpoint.dir if the session names one; otherwise the warehouse,
    which is shared as well. Never a machine-local temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to shared storage and read again: lineage ends here,

    and a lost executor costs a read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that no later step reads."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of scratch() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Spark's names of object stores that Arrow knows under another one.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def for_arrow(spark: SparkSession, folder: str) -> str:
    """The URI under which Arrow opens a folder that Spark names, on Spark's default file system if it has no scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    scheme = uri.getScheme()
    return f"{ARROW_SCHEMES.get(scheme, scheme)}://{uri.getAuthority() or ''}{uri.getPath()}"
