"""Product quantisation: training on a bounded sample, encoding, and distances on codes.

Quantiser is what a search needs of any quantisation: codes of vectors, and a
queries' distances to codes, pair by pair. Codebook and RotatedBits are two, and
graphs hold the codes of either.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.knn import matrix, merge_top_k, query_blocks
from orrery.storage import stored

SAMPLE = 256_000
CENTRES = 256


def chunk_offsets(dim: int, chunks: int) -> list[int]:
    """Balanced: the first dim % chunks chunks are one dimension wider."""
    if not 0 < chunks <= dim:
        raise ValueError("chunks must be between 1 and the dimension")
    low, more = divmod(dim, chunks)
    return [i * low + min(i, more) for i in range(chunks + 1)]


class Quantiser(ABC):
    #: Of the numbers that codes are made of, as they are stored.
    dtype: np.dtype

    @abstractmethod
    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, width) of vectors, of dtype."""

    @abstractmethod
    def prepare(self, queries: np.ndarray) -> object:
        """What pairs() needs of queries."""

    @abstractmethod
    def pairs(self, prepared, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of prepared queries (by number) to codes, pair by pair."""

    @abstractmethod
    def to_json(self) -> str:
        """As of_json() reads it."""

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Of a query to codes."""
        return self.pairs(self.prepare(q[None]), np.zeros(len(codes), dtype=np.int64), codes)

    def stored(self, codes: bytes, rows: int) -> np.ndarray:
        """Codes from the bytes of a table."""
        return np.frombuffer(codes, dtype=self.dtype).reshape(rows, -1)

    @staticmethod
    def of_json(text: str) -> Quantiser:
        return (RotatedBits if json.loads(text).get("kind") == "bits" else Codebook).from_json(text)


@dataclass
class Codebook(Quantiser):
    """pivots: (centres, dim); centroid is subtracted first, rotation applied after it."""

    pivots: np.ndarray
    offsets: list[int]
    centroid: np.ndarray
    rotation: np.ndarray | None = None
    lut: np.ndarray | None = field(default=None, repr=False)
    dtype = np.dtype("<i2")

    def turned(self, x: np.ndarray) -> np.ndarray:
        x = x - self.centroid
        return x if self.rotation is None else x @ self.rotation

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = self.turned(x)
        codes = np.empty((len(x), len(self.offsets) - 1), dtype=np.int16)
        for m, (a, b) in enumerate(zip(self.offsets, self.offsets[1:], strict=False)):
            d = np.zeros((len(x), len(self.pivots)))
            for j in range(a, b):
                d += (x[:, j, None] - self.pivots[None, :, j]) ** 2
            codes[:, m] = d.argmin(axis=1)
        return codes

    def inflate(self, codes: np.ndarray) -> np.ndarray:
        x = np.hstack([self.pivots[codes[:, m], a:b] for m, (a, b) in enumerate(zip(self.offsets, self.offsets[1:], strict=False))])
        return (x if self.rotation is None else x @ self.rotation.T) + self.centroid

    def table(self, q: np.ndarray) -> np.ndarray:
        """(chunks, centres): distances of a query's chunks to the centres (asymmetric)."""
        d = (self.turned(q[None]) - self.pivots) ** 2
        return np.stack([d[:, a:b].sum(axis=1) for a, b in zip(self.offsets, self.offsets[1:], strict=False)])

    def prepare(self, queries: np.ndarray) -> np.ndarray:
        return np.stack([self.table(q) for q in queries]) if len(queries) else np.zeros((0, len(self.offsets) - 1, len(self.pivots)))

    def pairs(self, prepared: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return prepared[rows[:, None], np.arange(codes.shape[1]), codes].sum(axis=1)

    def products(self, q: np.ndarray) -> np.ndarray:
        """(chunks, centres): by which inner products of a query with coded vectors are summed, negative, so that smaller is nearer."""
        if self.rotation is not None:
            raise ValueError("a rotated codebook has no chunks of the query's own dimensions")
        d = -(q * self.pivots)
        return np.stack([d[:, a:b].sum(axis=1) for a, b in zip(self.offsets, self.offsets[1:], strict=False)])

    def to_json(self) -> str:
        as_list = lambda x: None if x is None else np.asarray(x).tolist()
        return json.dumps({"pivots": as_list(self.pivots), "offsets": list(self.offsets), "centroid": as_list(self.centroid), "rotation": as_list(self.rotation)})

    @classmethod
    def from_json(cls, text: str) -> Codebook:
        d = json.loads(text)
        book = cls(np.array(d["pivots"]), d["offsets"], np.array(d["centroid"]), None if d["rotation"] is None else np.array(d["rotation"]))
        if book.pivots.shape[1] != len(book.centroid) or book.offsets[-1] != len(book.centroid):
            raise ValueError("the codebook's pivots, offsets and centroid don't go together")
        return book

    def save(self, spark: SparkSession, folder: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Codebook:
        return cls.from_json(spark.read.text(folder).first()[0])

    def symmetric(self) -> np.ndarray:
        """(chunks, centres, centres): distances of codes to codes."""
        if self.lut is None:
            parts = [self.pivots[:, a:b] for a, b in zip(self.offsets, self.offsets[1:], strict=False)]
            self.lut = np.stack([((p[:, None] - p[None]) ** 2).sum(axis=2) for p in parts])
        return self.lut


def kmeans_pp(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """D-squared seeding."""
    chosen = [int(rng.integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        share = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        chosen.append(int(rng.choice(len(x), p=share)))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen].copy()


def lloyd(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Stops when the residual falls by under 1e-5 of what it has become; a centre without points becomes zero."""
    before = None
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T
        near = d.argmin(axis=1)
        residual = float(d[np.arange(len(x)), near].sum())
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], 0.0)
        if residual < np.finfo(float).eps or before is not None and (before - residual) / residual < 1e-5:
            break
        before = residual
    return centres


def sampled(vectors: DataFrame, sample: int, seed: int, vec_col: str) -> DataFrame:
    """About `sample` of the rows with a vector, as array<double>; all, if there are no more."""
    own = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("vec"))
    n = own.count()
    return own if n <= sample else own.sample(fraction=sample / n, seed=seed)


def train(vectors: DataFrame, chunks: int, centres: int = CENTRES, rounds: int = 12, centred: bool = True, rotate: int = 0, seed: int = 1, vec_col: str = "embedding", sample: int = SAMPLE) -> Codebook:
    """A codebook from at most about `sample` rows. rotate: rounds of learning a rotation (0: none).

    Without one, each chunk is trained in a task of its own, which holds the sample's numbers of that chunk; the driver gets the
    centres alone. A rotation needs whole rows in one place: then the sample goes to the driver, as flat numbers.
    """
    if rotate:
        return _train_rotated(vectors, chunks, centres, centred, rotate, seed, vec_col, sample)
    rows = stored(sampled(vectors, sample, seed, vec_col), "pq-sample")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n < centres:
        raise ValueError(f"{n} rows are too few for {centres} centres")
    from orrery.operators.partitioning import centroids

    mean = [r["mean"] for r in centroids(rows.withColumn("all", F.lit(0)), "all", "vec").orderBy("pos").collect()] if centred else [0.0] * dim
    cuts, centroid = chunk_offsets(dim, chunks), np.array(mean)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0)) - centroid
                yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array([x[:, a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["chunk", "x"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(key[0])
        x = np.vstack([np.frombuffer(b).reshape(-1, cuts[m + 1] - cuts[m]) for b in pdf["x"]])
        x = x[np.lexsort(x.T[::-1])]  # in an order of their own, however the rows came
        pivots = lloyd(x, kmeans_pp(x, centres, np.random.default_rng([seed, m])), rounds)
        return pd.DataFrame({"chunk": [m], "pivots": [pivots.tobytes()]})

    found = rows.mapInArrow(cut, "chunk int, x binary").groupBy("chunk").applyInPandas(fit, "chunk int, pivots binary").orderBy("chunk").collect()
    return Codebook(np.hstack([np.frombuffer(r.pivots).reshape(centres, -1) for r in found]), cuts, centroid)


def _train_rotated(vectors: DataFrame, chunks: int, centres: int, centred: bool, rotate: int, seed: int, vec_col: str, sample: int) -> Codebook:
    column = sampled(vectors, sample, seed, vec_col).toArrow().column(0).combine_chunks()  # at most about `sample` rows
    x = matrix(column) if len(column) else np.zeros((0, 1))
    if len(x) < centres:
        raise ValueError(f"{len(x)} rows are too few for {centres} centres")
    x = x[np.lexsort(x.T[::-1])]
    rng, centroid = np.random.default_rng(seed), x.mean(axis=0) if centred else np.zeros(x.shape[1])
    x, cuts = x - centroid, chunk_offsets(x.shape[1], chunks)
    spans = list(zip(cuts, cuts[1:], strict=False))

    def pivots_of(x, old, rounds):
        return np.hstack([lloyd(x[:, a:b], kmeans_pp(x[:, a:b], centres, rng) if old is None else old[:, a:b], rounds) for a, b in spans])

    turn, pivots = np.eye(x.shape[1]), None
    for _ in range(rotate):
        y = x @ turn
        pivots = pivots_of(y, pivots, 8)
        book = Codebook(pivots, cuts, np.zeros(x.shape[1]))
        u, _, v = np.linalg.svd(x.T @ book.inflate(book.encode(y)))
        turn = u @ v
    return Codebook(pivots_of(x @ turn, pivots, 8), cuts, centroid, turn)


def encode(vectors: DataFrame, book: Codebook, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, code array<smallint>); no row moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = book.encode(matrix(b.column(1))) if b.num_rows else np.zeros((0, len(book.offsets) - 1), np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), lists], names=["id", "code"])

    return vectors.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInArrow(run, "id bigint, code array<smallint>")


def adc(queries: DataFrame, vectors: DataFrame, book: Codebook, k: int = 0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, id, dist): distances of a stated query set to codes, by one table for each query: the k nearest, or with k = 0 all.

    Queries go out in blocks; rows don't move; a task returns at most k rows for a query.
    """
    spark, out = vectors.sparkSession, None
    for ids, q, _ in query_blocks(queries, id_col, vec_col, []):
        sent = spark.sparkContext.broadcast((ids, np.stack([book.table(x) for x in q])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, tables = sent.value
            chunk = np.arange(tables.shape[1])
            best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
            as_batch = lambda i, own, d: pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own), pa.array(d)], names=["qid", "id", "dist"])
            for b in batches:
                own, codes = b.column(0).to_numpy(), np.stack(b.column(1).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, len(chunk)), np.int16)
                for n, (i, t) in enumerate(zip(ids, tables, strict=True)):
                    d = t[chunk, codes].sum(axis=1)
                    if not k:
                        yield as_batch(i, own, d)
                        continue
                    held, near = np.concatenate([best[n][0], own]), np.concatenate([best[n][1], d])
                    order = np.lexsort((held, near))[:k]
                    best[n] = held[order], near[order]
            for i, (own, d) in zip(ids, best, strict=True):
                yield as_batch(i, own, d)

        part = encode(vectors, book, id_col, vec_col).mapInArrow(run, "qid bigint, id bigint, dist double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid bigint, id bigint, dist double")
    return merge_top_k(out, k).drop("rank") if k else out


def symmetric_distance(a: Column, b: Column, lut: Column, centres: int) -> Column:
    """Code to code: the sum of lut[chunk][a's centre][b's centre]; lut is the book's flat table."""
    at = F.zip_with(a, b, lambda x, y: x.cast("int") * centres + y.cast("int"))
    return F.aggregate(F.transform(at, lambda x, m: F.get(lut, m * centres * centres + x)), F.lit(0.0), lambda s, x: s + x)


def with_lut(df: DataFrame, book: Codebook) -> DataFrame:
    """df with the book's flat table of code distances as column lut, sent once to each task: chunks * centres^2 numbers."""
    table = df.sparkSession.createDataFrame([(book.symmetric().ravel().tolist(),)], "lut array<double>")
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(table.withColumn("__one", F.lit(1))), "__one").drop("__one")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthogonal Hadamard matrix; their length is a power of two."""
    n, y, half = x.shape[1], np.array(x, dtype=np.float64), 1
    while half < n:
        y = y.reshape(len(x), -1, 2, half)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return y / np.sqrt(n)


@dataclass
class RotatedBits(Quantiser):
    """Codes of 1 to 8 bits a dimension, of residuals from the nearest of a few centres after a random rotation, which is made of two

    rounds of sign flips and a Hadamard transform. With each code go four numbers and its centre; they make the estimate of a
    distance unbiased over rotations. Queries are cut to QUERY_BITS bits, and products of codes are bits counted. Symmetric
    distances have no form here.
    """

    centroid: np.ndarray
    centres: np.ndarray  # from the centroid
    bits: int = 1
    seed: int = 1
    dtype = np.dtype("u1")
    QUERY_BITS = 4
    #: Of the scales by which a residual meets the grid of codes, those that are tried, as shares of the one that uses all of it.
    SCALES = (0.35, 0.5, 0.65, 0.8, 0.9, 1.0)

    def __post_init__(self):
        if not 1 <= self.bits <= 8:
            raise ValueError("bits must be from 1 to 8")
        dim = len(self.centroid)
        self.size = max(64, 1 << (dim - 1).bit_length())
        self.signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], size=(2, self.size))
        self.plane = self.size // 8
        self.turned_centres = self.turn(self.centres)

    @property
    def width(self) -> int:
        """Bytes of a code."""
        return self.bits * self.plane + 17

    @classmethod
    def of(cls, x: np.ndarray, bits: int = 1, clusters: int = 16, seed: int = 1) -> RotatedBits:
        """From vectors in memory."""
        centroid = x.mean(axis=0)
        own = x - centroid
        return cls(centroid, lloyd(own, kmeans_pp(own, min(clusters, len(x)), np.random.default_rng(seed)), 10), bits, seed)

    @classmethod
    def train(cls, vectors: DataFrame, bits: int = 1, clusters: int = 16, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", rounds: int = 10) -> RotatedBits:
        """The centres are those of k-means over all rows."""
        from orrery.operators.partitioning import kmeans, random_pivots

        centres, _ = kmeans(vectors, random_pivots(vectors, clusters, id_col, vec_col, seed), rounds, vec_col)
        centroid = centres.mean(axis=0)
        return cls(centroid, centres - centroid, bits, seed)

    def turn(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for flips in self.signs:
            y = hadamard(y * flips)
        return y

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, width): a plane for each bit, the residual's squared norm, the scale, the code's product with the centre and sum, the centre's number."""
        own = np.asarray(x, dtype=np.float64) - self.centroid
        near = ((own * own).sum(1)[:, None] + (self.centres ** 2).sum(1)[None] - 2 * own @ self.centres.T).argmin(axis=1)
        y = self.turn(own - self.centres[near])
        levels, middle = 1 << self.bits, (1 << self.bits) / 2 - 0.5
        best, code = np.full(len(y), -np.inf), np.zeros(y.shape, dtype=np.uint8)
        most = np.maximum(np.abs(y).max(axis=1), 1e-30)[:, None] if len(y) else np.ones((0, 1))
        for scale in self.SCALES if self.bits > 1 else (1.0,):
            u = np.clip(np.floor(y / most * (levels / 2) / scale + levels / 2), 0, levels - 1)
            c = u - middle
            fit = (c * y).sum(axis=1) / np.sqrt((c * c).sum(axis=1))
            better = fit > best
            best[better], code[better] = fit[better], u[better].astype(np.uint8)
        c = code - middle
        norm, product = (y * y).sum(axis=1), (c * y).sum(axis=1)
        numbers = np.stack([norm, np.where(product > 0, norm / np.where(product > 0, product, 1), 0.0), (c * self.turned_centres[near]).sum(axis=1), code.sum(axis=1, dtype=np.int64)], axis=1).astype("<f4")
        planes = [np.packbits((code >> i) & 1, axis=1, bitorder="little") for i in range(self.bits)]
        return np.ascontiguousarray(np.hstack([*planes, numbers.view(np.uint8).reshape(len(y), 16), near[:, None].astype(np.uint8)]))

    def prepare(self, queries: np.ndarray) -> tuple:
        own = np.asarray(queries, dtype=np.float64) - self.centroid
        y, top = self.turn(own), (1 << self.QUERY_BITS) - 1
        low = y.min(axis=1, initial=0)[:, None]
        step = np.maximum((y.max(axis=1, initial=0)[:, None] - low) / top, 1e-30)
        u = np.rint((y - low) / step).astype(np.uint8)
        planes = np.stack([np.packbits((u >> j) & 1, axis=1, bitorder="little") for j in range(self.QUERY_BITS)], axis=1)
        apart = (own * own).sum(1)[:, None] + (self.centres ** 2).sum(1)[None] - 2 * own @ self.centres.T
        return np.ascontiguousarray(planes).view("<u8"), low[:, 0], step[:, 0], y.sum(axis=1), apart

    def pairs(self, prepared: tuple, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        planes, low, step, total, apart = prepared
        own = np.ascontiguousarray(codes[:, : self.bits * self.plane]).view("<u8").reshape(len(codes), self.bits, -1)
        norm, scale, centre, ones = np.ascontiguousarray(codes[:, -17:-1]).view("<f4").astype(np.float64).T
        asked, product = planes[rows], np.zeros(len(codes))
        for i in range(self.bits):
            for j in range(self.QUERY_BITS):
                product += float(1 << (i + j)) * np.bitwise_count(own[:, i] & asked[:, j]).sum(axis=1, dtype=np.int64)
        product = step[rows] * product + low[rows] * ones - ((1 << self.bits) / 2 - 0.5) * total[rows]
        return norm + apart[rows, codes[:, -1]] - 2 * scale * (product - centre)

    def to_json(self) -> str:
        return json.dumps({"kind": "bits", "centroid": self.centroid.tolist(), "centres": self.centres.tolist(), "bits": self.bits, "seed": self.seed})

    @classmethod
    def from_json(cls, text: str) -> RotatedBits:
        d = json.loads(text)
        return cls(np.array(d["centroid"]), np.array(d["centres"]), d["bits"], d["seed"])


def random_rotation(dim: int, seed: int = 1) -> np.ndarray:
    """An orthogonal matrix, uniform over all."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(vectors: DataFrame, rotation: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec array<double>): vectors times a matrix; no row moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = matrix(b.column(1)) @ rotation if b.num_rows else np.zeros((0, rotation.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), lists], names=["id", "vec"])

    return vectors.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInArrow(run, "id bigint, vec array<double>")


def elkan(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """lloyd() by bounds: a point is compared with a centre only if the triangle inequality doesn't rule it out. The same centres."""
    near = None
    before = None
    for _ in range(rounds):
        between = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
        if near is None:
            d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(axis=2))
            near, lower = d.argmin(axis=1), d
        upper = np.sqrt(((x - centres[near]) ** 2).sum(axis=1))
        maybe = (lower <= upper[:, None]) & (between[near] <= 2 * upper[:, None])
        rows, cols = np.nonzero(maybe)
        lower[rows, cols] = np.sqrt(((x[rows] - centres[cols]) ** 2).sum(axis=1))
        own = np.where(maybe, lower, np.inf)
        own[np.arange(len(x)), near] = upper
        near = own.argmin(axis=1)
        residual = float((own[np.arange(len(x)), near] ** 2).sum())
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], 0.0)
        lower = np.maximum(lower - np.sqrt(((new - centres) ** 2).sum(axis=1))[None], 0.0)
        centres = new
        if residual < np.finfo(float).eps or before is not None and (before - residual) / residual < 1e-5:
            break
        before = residual
    return centres
