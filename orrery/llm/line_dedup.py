"""Reversible line dedup: exact reference counts with sharded cuckoo filters (operator 5).

The table of truth has, for each line key, the number of documents that hold it.
Inserting or deleting documents adds or takes away counts, so any insertion can
be undone exactly. Keys at or over the threshold are frequent. Each shard of
keys keeps a cuckoo filter of its frequent keys, which takes insertions and
deletions as counts cross the threshold, and beside it the few infrequent keys
of the table that the filter would wrongly claim; both together answer exactly
for every key of the table. Lines are always asked of the filters. If these are
within FILTER_BYTES together (measured), they go to all tasks; beyond that the
documents' keys go to the filter of their shard, a shard with many keys in
several tasks with a copy of its filter each, and frequent ones come back.

A line's key is the 128-bit BLAKE2b digest of the line without white space at
both ends, A-Z lower-cased. Defined results: null or empty text is one empty
line; empty keys are never frequent; texts and lines of any length are taken
whole; a key in just as many documents as the threshold is frequent; rows with a
null id count; repeated rows are documents of their own; an empty table gives an
empty result; deleting documents that were never inserted is an error when the
index would hold a key fewer than zero times; other columns pass through, but
for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.shared import LOWER, SPACE, encoded, slices, stored

MIN_DOCUMENTS = 10
MIN_CHARS = 1
SHARD_KEYS = 200_000
FILTER_BYTES = 64 << 20
#: Keys of documents that one task asks of a shard's filter.
ASKED_KEYS = 500_000
SLOTS, MAX_KICKS, LOAD = 4, 500, 0.85


def line_keys(lines: list[bytes], min_chars: int = MIN_CHARS) -> list[bytes]:
    """16-byte keys; an empty one for a line whose key is too short to count."""
    out = []
    for x in lines:
        x = x.strip(SPACE).translate(LOWER)
        short = not x or (min_chars > 1 and len(x.decode()) < min_chars)
        out.append(b"" if short else hashlib.blake2b(x, digest_size=16).digest())
    return out


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a fingerprint's two buckets follow from each other."""

    def __init__(self, n_keys: int = 0, table: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(n_keys, 1) / SLOTS / LOAD))) if n_keys else 1)
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16) if table is None else table
        self.mask = len(self.table) - 1
        self.rng = np.random.default_rng(5)

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(blob, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: (n, 2) uint64. Fingerprints and both buckets."""
        fp = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        one = ((keys[:, 1] >> np.uint64(16)) & np.uint64(self.mask)).astype(np.int64)
        return fp, one, self.other(fp, one)

    def other(self, fp, bucket):
        return bucket ^ ((fp.astype(np.int64) * 0x5BD1E995 >> 7) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self.places(keys)
        return ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if one finds no place; the filter is then to be built anew, larger."""
        for fp, one, two in zip(*self.places(keys), strict=True):
            for bucket in (one, two):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = fp
                    break
            else:
                bucket = two
                for _ in range(MAX_KICKS):
                    slot = int(self.rng.integers(SLOTS))
                    fp, self.table[bucket, slot] = self.table[bucket, slot], fp
                    bucket = self.other(np.uint16(fp), bucket)
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """keys must have been inserted."""
        for fp, one, two in zip(*self.places(keys), strict=True):
            for bucket in (one, two):
                held = np.flatnonzero(self.table[bucket] == fp)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break


def as_pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)


def shard_of(keys: list[bytes], shards: int) -> np.ndarray:
    """By the key's first four bytes; shard_column() says the same in SQL."""
    if not keys:
        return np.zeros(0, dtype=np.int64)
    return np.frombuffer(b"".join(keys), dtype=">u4").reshape(-1, 4)[:, 0].astype(np.int64) % shards


def shard_column(shards: int) -> Column:
    return (F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("bigint") % shards).cast("int")


def count_lines(docs: DataFrame, sign: int = 1, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, n): how many of docs hold each key, times sign; added up in each batch before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[bytes] = Counter()
            for part in slices(iter([b])):
                for text in encoded(part.column(0)):
                    counts.update(set(line_keys(text.split(b"\n"), min_chars)))
            counts.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])

    own = docs.select(text_col).mapInArrow(run, "key binary, n bigint")
    return own.groupBy("key").agg((F.sum("n") * sign).alias("n"))


FILTERS = "shard int, filter binary, wrong binary"


class LineIndex:
    """Reference counts and filters after some insertions and deletions. Every step gives a new index."""

    def __init__(self, spark: SparkSession, counts: DataFrame | None = None, filters: DataFrame | None = None, shards: int = 1, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS):
        self.spark, self.shards, self.min_documents, self.min_chars = spark, shards, min_documents, min_chars
        self.counts = spark.createDataFrame([], "key binary, n bigint") if counts is None else counts
        self.filters = spark.createDataFrame([], FILTERS) if filters is None else filters

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._change(count_lines(docs, 1, text_col, self.min_chars))

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Takes back documents that were inserted."""
        return self._change(count_lines(docs, -1, text_col, self.min_chars))

    def _change(self, delta: DataFrame) -> LineIndex:
        both = self.counts.select("key", F.col("n").alias("old"), F.lit(0).cast("bigint").alias("change")).unionByName(delta.select("key", F.lit(0).cast("bigint").alias("old"), F.col("n").alias("change")))
        summed = both.groupBy("key").agg(F.sum("old").alias("old"), F.sum("change").alias("change"))
        n = F.col("old") + F.col("change")
        merged = stored(summed.withColumn("n", F.when(n >= 0, n).otherwise(F.raise_error(F.lit("documents are deleted that were never inserted")))), "line-counts")
        keys = merged.count()
        shards = max(self.shards, -(-keys // SHARD_KEYS))
        least = self.min_documents
        # After a change of the number of shards the old filters don't fit, and all are built anew.
        old_filters = self.filters if shards == self.shards else self.spark.createDataFrame([], FILTERS)

        def maintain(key: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            pairs = as_pairs(list(rows["key"]))
            old, new = rows["old"].to_numpy(), rows["n"].to_numpy()
            often = new >= least
            fits, f = False, None
            if len(filters):
                f = CuckooFilter.from_bytes(filters["filter"].iloc[0])
                f.delete(pairs[(old >= least) & ~often])
                fits = f.insert(pairs[often & (old < least)])
            size = int(often.sum())
            while not fits:
                f = CuckooFilter(size)
                fits, size = f.insert(pairs[often]), 2 * size + SLOTS
            rest = pairs[~often & (new > 0)]
            return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()], "wrong": [rest[f.contains(rest)].tobytes()]})

        grouped = merged.withColumn("shard", shard_column(shards)).groupBy("shard")
        # A shard has SHARD_KEYS keys on average, of uniform digests.
        filters = stored(grouped.cogroup(old_filters.groupBy("shard")).applyInPandas(maintain, FILTERS), "line-filters")
        counts = merged.filter("n <> 0").select("key", "n")
        return LineIndex(self.spark, counts, filters, shards, self.min_documents, self.min_chars)

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("n") >= self.min_documents).select("key")

    def clean(self, docs: DataFrame, text_col: str = "text", filter_bytes: int = FILTER_BYTES, inserted: bool = True) -> DataFrame:
        """docs with the text's frequent lines dropped, and n_lines and n_dropped.

        inserted: every line of docs has been inserted, so that the filters with their wrongly claimed keys are exact. If not so, say False:
        what the filters claim is then looked up in the exact counts.
        """
        docs = docs.drop("n_lines", "n_dropped")
        if not inserted:
            return self._by_shards(docs, text_col, exactly=True)
        size = self.filters.agg(F.sum(F.length("filter") + F.length("wrong"))).first()[0] or 0
        return self._by_sent_filters(docs, text_col) if size <= filter_bytes else self._by_shards(docs, text_col)

    def _by_sent_filters(self, docs: DataFrame, text_col: str) -> DataFrame:
        rows = self.filters.collect()  # at most FILTER_BYTES
        sent = self.spark.sparkContext.broadcast([(r.shard, bytes(r.filter), bytes(r.wrong)) for r in rows])
        shards = self.shards

        def frequent_of(keys: list[bytes], filters: dict[int, tuple]) -> set[bytes]:
            shard, found = shard_of(keys, shards), set()
            for k in np.unique(shard):
                if k in filters:
                    f, wrong = filters[k]
                    own = [keys[i] for i in np.flatnonzero(shard == k)]
                    found |= {x for x, hit in zip(own, f.contains(as_pairs(own)), strict=True) if hit and x not in wrong}
            return found

        def opened() -> dict[int, tuple]:
            return {k: (CuckooFilter.from_bytes(f), {w[i:i + 16] for i in range(0, len(w), 16)}) for k, f, w in sent.value}

        def gone(filters, keys: list[list[bytes]]) -> list[np.ndarray]:
            distinct = list({k for x in keys for k in x} - {b""})
            drop = frequent_of(distinct, filters) if distinct and filters else set()
            return [np.array([k in drop for k in ks], dtype=bool) for ks in keys]

        return self._cut(docs, text_col, opened, lambda filters, keys, _: gone(filters, keys))

    def _cut(self, docs: DataFrame, text_col: str, prepare, gone, more: int = 0) -> DataFrame:
        """docs without the lines that gone() marks; more: how many columns at the end only gone() needs."""
        at, min_chars = docs.columns.index(text_col), self.min_chars
        own = docs.schema.fields[: len(docs.columns) - more]
        schema = T.StructType([*own, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = prepare()
            for b in slices(batches):
                lines = [x.split(b"\n") for x in encoded(b.column(at))]
                drop = gone(state, [line_keys(x, min_chars) for x in lines], b)
                kept = [b"\n".join(x for x, d in zip(own, ds, strict=True) if not d) for own, ds in zip(lines, drop, strict=True)]
                columns = list(b.columns)[: b.num_columns - more]
                columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
                n, dropped = pa.array([len(x) for x in lines], pa.int64()), pa.array([int(x.sum()) for x in drop], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, n, dropped], names=schema.names)

        return docs.mapInArrow(run, schema)

    def _by_shards(self, docs: DataFrame, text_col: str, exactly: bool = False) -> DataFrame:
        """The same for filters of any size: documents' keys meet their shard's filter, and what is frequent goes back by row."""
        at = unused("row", docs.columns)
        numbered = stored(docs.withColumn(at, F.monotonically_increasing_id()), "numbered")
        min_chars, shards = self.min_chars, self.shards

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                keys = [line_keys(x.split(b"\n"), min_chars) for x in encoded(b.column(1))]
                rows = [(r, k) for r, ks in zip(b.column(0).to_pylist(), keys, strict=True) for k in set(ks) - {b""}]
                own = [k for _, k in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array(own, pa.binary()), pa.array(shard_of(own, shards), pa.int32())], names=["row", "key", "shard"])

        asked = stored(numbered.select(at, text_col).mapInArrow(keyed, "row bigint, key binary, shard int"), "asked-keys")
        # A line that many documents have makes its shard large; its keys are dealt over several tasks. There are few such shards
        # (at most one for ASKED_KEYS rows); Spark sends their list to all tasks if it is small enough.
        large = stored(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ASKED_KEYS).cast("int").alias("parts")).filter("parts > 1"), "large-shards")
        parts = F.coalesce("parts", F.lit(1))
        dealt = asked.join(large, "shard", "left").select("row", "key", "shard", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"))
        copies = self.filters.join(large, "shard", "left").select("shard", "filter", "wrong", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

        def ask(key: tuple, rows: pa.Table, filters: pa.Table) -> pa.Table:
            frequent = np.zeros(len(rows), dtype=bool)
            if len(filters) and len(rows):
                f, wrong = CuckooFilter.from_bytes(filters.column("filter")[0].as_py()), filters.column("wrong")[0].as_py()
                wrong = {wrong[i:i + 16] for i in range(0, len(wrong), 16)}
                keys = rows.column("key").to_pylist()
                frequent = f.contains(as_pairs(keys))
                frequent[frequent] = [keys[i] not in wrong for i in np.flatnonzero(frequent)]
            return rows.select(["row", "key"]).filter(pa.array(frequent))

        found = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(ask, "row bigint, key binary")
        if exactly:
            found = found.join(self.frequent(), "key", "left_semi")
        held = unused("keys", docs.columns)
        drop = found.groupBy("row").agg(F.collect_set("key").alias(held)).withColumnRenamed("row", at)
        joined = numbered.join(drop, at, "left").select(*[F.col(f"`{c}`") for c in docs.columns], held)

        def gone(_, keys: list[list[bytes]], b: pa.RecordBatch) -> list[np.ndarray]:
            drops = [set(x or ()) for x in b.column(b.num_columns - 1).to_pylist()]
            return [np.array([k in d for k in ks], dtype=bool) for ks, d in zip(keys, drops, strict=True)]

        return self._cut(joined, text_col, lambda: None, gone, 1)


def unused(name: str, columns: list[str]) -> str:
    """name, or name with underscores before it, so that no column has it."""
    while name in columns:
        name = f"_{name}"
    return name
