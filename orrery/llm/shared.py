"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.storage import discard, for_arrow, remove, scratch, stored

__all__ = ["LOWER", "SPACE", "Out", "discard", "encoded", "for_arrow", "give_back", "of_keys", "remove", "scratch", "shuffle_partitions", "slices", "stored", "tidied_shuffles"]

#: Lower-cases A-Z alone, on UTF-8 bytes.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The white space of the contracts: [\x20\x09-\x0D], which is also what bytes.split() splits at.
SPACE = b" \t\n\x0b\x0c\r"

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with over 1 / HOT of all rows is hot.
HOT = 1000


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that Python objects exist for few rows at a time. At their end a worker gives memory back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Returns what is freed to the system, so that a worker that waits between tasks is small. A C library without malloc_trim keeps it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@contextmanager
def tidied_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes a query's shuffle files when the query ends; without it they stay until the driver collects its plan."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Out:
    """A file in shared storage that appears under its name when it is complete,

    so that a task that is repeated or runs twice leaves a whole file.
    """

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.own)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.own, self.path)


def of_keys(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of keys, of whose keys they have one. keys: (key, n, ...), n being the key's rows among the total.

    A key with over 1 / HOT of the rows is hot; fewer than HOT can be, so they go to all tasks, and their rows don't move.
    """
    hot = F.col("n") * HOT > total
    return rows.join(F.broadcast(keys.filter(hot)), key).unionByName(rows.join(F.broadcast(keys.filter(hot).select(key)), key, "left_anti").join(keys.filter(~hot), key))
