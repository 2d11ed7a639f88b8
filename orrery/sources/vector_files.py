"""Vector files as a Spark data source.

    spark.dataSource.register(VectorFiles)
    spark.read.format("vectors").option("layout", "bin").option("dtype", "float").load(path)
    df.write.format("vectors").option("layout", "bin").mode("overwrite").save(folder)

Layouts: bin (two 32-bit counts, rows and dimension, then rows) and vecs (the
dimension before every row). Elements: float, int8, uint8, int32. A row's number
is its id; files of a folder are read in order of their names, numbered on. Writing
makes one file for each task, named by the first id, as rows come (sort them
within partitions, after repartitionByRange, for a folder that reads back in
order); mode overwrite takes away what the folder had when all tasks are done.

Truth files (truth_rows, write_truth_rows) hold k ids and distances of each
query; range truth files ragged lists. Ids are 32-bit in all of these formats.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from orrery.storage import ARROW_SCHEMES

DTYPES = {"float": "<f4", "int8": "i1", "uint8": "u1", "int32": "<i4"}
ELEMENT = {"float": "float", "int8": "tinyint", "uint8": "smallint", "int32": "int"}
LAYOUTS = ("bin", "vecs")
ROWS_A_SPLIT = 1 << 18


def checked(options: dict) -> tuple[str, str]:
    layout, dtype = options.get("layout", "bin"), options.get("dtype", "float")
    if layout not in LAYOUTS or dtype not in DTYPES:
        raise ValueError(f"layout must be one of {LAYOUTS} and dtype one of {tuple(DTYPES)}")
    return layout, dtype


def opened(path: str):
    """Arrow's file system and the path in it. A path without a scheme is a local one; storage.for_arrow() gives that of a path as Spark
    resolves it."""
    scheme, _, rest = path.rpartition("://")
    return pafs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme) or 'file'}://{rest}")


def header(path: str, layout: str, dtype: str) -> tuple[int, int]:
    """(rows, dimension), checked against the file's size."""
    fs, inner = opened(path)
    size, width = fs.get_file_info(inner).size, np.dtype(DTYPES[dtype]).itemsize
    with fs.open_input_file(inner) as f:
        if layout == "bin":
            n, dim = np.frombuffer(f.read(8), "<u4").tolist()
            right = size == 8 + n * dim * width
        else:
            dim = int(np.frombuffer(f.read(4), "<i4")[0]) if size else 0
            n = size // (4 + dim * width)
            right = size == n * (4 + dim * width)
    if not right:
        raise ValueError(f"{path}: {size} bytes don't make rows of {dim} elements under its header")
    return n, dim


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    end: int
    number: int


def files_of(path: str) -> list[str]:
    """The file, or a folder's files in order of their names; hidden and unfinished ones don't count."""
    fs, inner = opened(path)
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.is_file and not f.base_name.startswith(("_", ".")) and f.extension != "part")
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    return [f"{scheme}{f}" for f in found]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.layout, self.dtype = checked(options)
        self.files = [(f, *header(f, self.layout, self.dtype)) for f in files_of(options["path"])]
        dims = {dim for _, n, dim in self.files if n}
        if len(dims) > 1:
            raise ValueError(f"{options['path']} has files of dimensions {sorted(dims)}")
        self.dim = max(dims, default=0)
        first, last = int(options.get("first", 0)), options.get("end")
        self.first, self.end = first, None if last is None else int(last)

    def partitions(self) -> list[Rows]:
        """Ranges of rows; options first and end choose rows by number."""
        out, number = [], 0
        for f, n, _ in self.files:
            for a in range(0, n, ROWS_A_SPLIT):
                lo, hi = max(a, self.first - number), min(a + ROWS_A_SPLIT, n, n if self.end is None else self.end - number)
                if lo < hi:
                    out.append(Rows(f, lo, hi, number))
            number += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.end:
            return
        fs, inner = opened(partition.path)
        kind = np.dtype(DTYPES[self.dtype])
        row, skip = self.dim * kind.itemsize + 4 * (self.layout == "vecs"), 8 * (self.layout == "bin")
        element = {"float": pa.float32(), "int8": pa.int8(), "uint8": pa.int16(), "int32": pa.int32()}[self.dtype]
        with fs.open_input_file(inner) as f:
            f.seek(skip + partition.first * row)
            for a in range(partition.first, partition.end, 4096):
                b = min(a + 4096, partition.end)
                x = np.frombuffer(f.read((b - a) * row), np.uint8).reshape(b - a, row)[:, row - self.dim * kind.itemsize:]
                flat = pa.array(np.ascontiguousarray(x).view(kind).ravel()).cast(element)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * self.dim + 1, max(self.dim, 1))[: b - a + 1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b) + partition.number, pa.int64()), lists], names=["id", "vec"])


@dataclass
class Written(WriterCommitMessage):
    name: str


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.folder, self.overwrite, (self.layout, self.dtype) = options["path"], overwrite, checked(options)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A batch at a time; the count of rows is written into the header at the end."""
        kind = np.dtype(DTYPES[self.dtype])
        fs, inner = opened(self.folder)
        fs.create_dir(inner, recursive=True)
        own, rows, dim, first = f"{inner}/{uuid.uuid4().hex}.part", 0, 0, None
        body = f"{own}.part"
        with fs.open_output_stream(body) as f:
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)
                if dim not in (0, x.shape[1]):
                    raise ValueError(f"vectors of {dim} and {x.shape[1]} elements")
                first, dim, rows = b.column("id")[0].as_py() if first is None else first, x.shape[1], rows + len(x)
                if self.layout == "vecs":
                    x = np.hstack([np.full((len(x), 1), dim, "<i4").view(np.uint8).reshape(len(x), 4), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)])
                f.write(x.tobytes())
        name = f"{inner}/{first or 0:016d}-{own.rpartition('/')[2][:8]}.{self.layout}"
        if self.layout == "vecs":
            fs.move(body, own)
        else:  # the header, and then the rows in pieces
            with fs.open_output_stream(own) as f, fs.open_input_stream(body) as g:
                f.write(np.array([rows, dim], "<u4").tobytes())
                while piece := g.read(8 << 20):
                    f.write(piece)
            fs.delete_file(body)
        return Written(f"{own}>{name}")

    def commit(self, messages) -> None:
        fs, inner = opened(self.folder)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if f.is_file and f.extension != "part"] if self.overwrite else []
        for path in old:
            fs.delete_file(path)
        for m in messages:
            fs.move(*m.name.split(">"))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                fs, _ = opened(self.folder)
                fs.delete_file(m.name.split(">")[0])


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return f"id bigint, vec array<{ELEMENT[checked(self.options)[1]]}>"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def read_truth(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (queries, k) of a truth file: two 32-bit counts, all ids, then all distances. Small by nature."""
    fs, inner = opened(path)
    with fs.open_input_file(inner) as f:
        data = f.read()
    n, k = np.frombuffer(data[:8], "<i4").tolist()
    if len(data) not in (8 + 4 * n * k, 8 + 8 * n * k):
        raise ValueError(f"{path} is no truth file of {n} x {k}")
    ids = np.frombuffer(data, "<u4", n * k, 8).reshape(n, k)
    return ids, np.frombuffer(data, "<f4", n * k, 8 + 4 * n * k).reshape(n, k) if len(data) > 8 + 4 * n * k else np.zeros((n, k), np.float32)


def write_truth(path: str, ids: np.ndarray, dist: np.ndarray) -> None:
    fs, inner = opened(path)
    with fs.open_output_stream(inner) as f:
        f.write(np.array(ids.shape, "<i4").tobytes() + ids.astype("<u4").tobytes() + dist.astype("<f4").tobytes())


def truth_rows(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(qid, id, dist, rank) of a truth file; queries are numbered from `first`."""
    ids, dist = read_truth(path)
    n, k = ids.shape
    table = pa.table({"qid": pa.array(np.repeat(np.arange(first, first + n), k)), "id": pa.array(ids.astype(np.int64).ravel()), "dist": pa.array(dist.astype(np.float64).ravel()), "rank": pa.array(np.tile(np.arange(1, k + 1), n).astype(np.int32))})
    return spark.createDataFrame(table)


def write_truth_rows(truth: DataFrame, path: str) -> None:
    """A truth file of (qid, id, dist, rank), queries in order of their ids, which must have as many ranks each. A query set is small by nature."""
    rows = truth.select("qid", "id", "dist", "rank").orderBy("qid", "rank").toArrow()
    n = len(rows.column("qid").unique())
    if len(rows) % max(n, 1) or (n and set(np.bincount(rows.column("rank").to_numpy())[1:]) != {n}):
        raise ValueError("a truth file needs as many ranks for each query")
    shape = (n, len(rows) // max(n, 1))
    write_truth(path, rows.column("id").to_numpy().reshape(shape), rows.column("dist").to_numpy().reshape(shape))


def write_range_truth(truth: DataFrame, queries: DataFrame, path: str) -> None:
    """Ragged lists of (qid, id, dist), nearest first, for every query (qid): the counts of queries and of all ids, each query's count, then ids.

    Tasks write the ids of ranges of queries beside it, and one task puts them behind the counts, in bounded pieces. The driver sees
    a count for each query.
    """
    spark = truth.sparkSession
    lists = queries.select("qid").distinct().join(truth.select("qid", "id", "dist"), "qid", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("dist", "id")))).alias("l"))
    lists = lists.select("qid", F.transform("l", lambda x: x["id"]).alias("ids")).repartitionByRange("qid").sortWithinPartitions("qid")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = opened(path)
        name, n = f"{inner}.{uuid.uuid4().hex}.part", 0
        with fs.open_output_stream(name) as f:
            for b in batches:
                f.write(b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
                n += b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).value_lengths().cast(pa.int64()), pa.array([name] * b.num_rows)], names=["qid", "n", "name"])
        if not n:
            fs.delete_file(name)

    rows = lists.mapInArrow(write, "qid bigint, n bigint, name string").toArrow()  # of a stated query set
    order = np.argsort(rows.column("qid").to_numpy(), kind="stable")
    sizes, names = rows.column("n").to_numpy()[order], rows.column("name").to_pylist()
    pieces = list(dict.fromkeys(names[i] for i in order))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs, inner = opened(path)
            with fs.open_output_stream(inner) as f:
                f.write(np.array([len(sizes), sizes.sum(), *sizes], "<u4").tobytes())
                for name in pieces:
                    with fs.open_input_stream(name) as g:
                        while piece := g.read(8 << 20):
                            f.write(piece)
            yield b

    spark.range(1).coalesce(1).mapInArrow(join, "id bigint").collect()
    fs, _ = opened(path)
    for name in pieces:
        fs.delete_file(name)


#: Ids of a range truth file that a task reads.
IDS_A_SPLIT = 1 << 20


def range_truth_rows(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(qid, ids) of a range truth file, its sizes checked. The driver reads the counts, tasks the ids."""
    fs, inner = opened(path)
    size = fs.get_file_info(inner).size
    with fs.open_input_file(inner) as f:
        n, total = np.frombuffer(f.read(8), "<u4").tolist()
        sizes = np.frombuffer(f.read(4 * n), "<u4").astype(np.int64)
    if size != 4 * (2 + n + total) or len(sizes) != n or sizes.sum() != total:
        raise ValueError(f"{path} is no range truth file of {n} queries and {total} ids")
    ends = np.cumsum(sizes)
    split = (ends - sizes) // IDS_A_SPLIT
    begins = np.flatnonzero(np.diff(split, prepend=-1)).tolist()
    splits = [(first + a, 4 * (2 + n) + 4 * int(ends[a] - sizes[a]), sizes[a:b].tolist()) for a, b in zip(begins, [*begins[1:], n], strict=True)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = opened(path)
        with fs.open_input_file(inner) as f:
            for b in batches:
                for qid, at, own in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    ids = np.frombuffer(f.read_at(4 * sum(own), at), "<u4").astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32()), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(qid, qid + len(own))), lists], names=["qid", "ids"])

    table = spark.createDataFrame(splits, "qid bigint, at bigint, sizes array<bigint>").repartition(max(1, len(splits)))
    return table.mapInArrow(read, "qid bigint, ids array<bigint>")


def id_lines(lines: DataFrame) -> DataFrame:
    """(id) of text lines (value) with one node each, # beginning a comment; anything else is an error."""
    text = F.trim(F.regexp_replace("value", "#.*$", ""))
    return lines.filter(text != "").select(F.when(text.rlike(r"^\d+$"), text.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not a node: "), "value"))).alias("id"))


def label_lines(lines: DataFrame) -> DataFrame:
    """(pos, labels array<string>) of lines (pos, value) with a row's labels, separated by commas; white space around them doesn't count."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return lines.select("pos", F.filter(parts, lambda x: x != "").alias("labels"))
