"""Sizing and dealing of rows to partitions and shards."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.knn import exact, matrix
from orrery.storage import discard, stored


def index_bytes(n: int, dim: int, element_bytes: int = 4, degree: int = 32) -> float:
    """Memory that building a graph over n vectors needs: padded vectors, neighbour lists with slack, and per-row state."""
    padded = -(-dim // 8) * 8
    return 1.1 * (n * padded * element_bytes + n * degree * 4 * 1.3 + 40 * n + 8 * n)


def least_partitions(n: int, dim: int, budget: float, degree: int = 32, element_bytes: int = 4, fraction: float = 1.0) -> int:
    """The least number of partitions of which any two fit the budget together."""
    if n <= 0 or budget <= 0:
        raise ValueError("n and budget must be positive")
    fits = lambda p: 2 * index_bytes(-(-n // p), dim, element_bytes, degree) <= budget * fraction
    high = 1
    while not fits(high):
        if high >= n:
            raise ValueError("two partitions of one row exceed the budget")
        high = min(2 * high, n)
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def largest_shard(dim: int, budget: float, degree: int = 32, element_bytes: int = 4, fraction: float = 1.0) -> int:
    """The most rows of which a graph can be built within the budget."""
    fits = lambda n: index_bytes(n, dim, element_bytes, degree) <= budget * fraction
    high = 1
    while fits(high):
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def shards_needed(n: int, largest: int, copies: float) -> int:
    """How many shards of at most `largest` rows take n rows, each up to `copies` times."""
    if largest < 1:
        raise ValueError("not even one row fits the budget")
    return max(1, -(-int(copies * n) // largest))


def contiguous(id_col, n: int, parts: int) -> Column:
    """The number of the id's range: parts ranges of 0..n-1, of which the first n % parts have one row more."""
    if parts < 1:
        raise ValueError("parts must be positive")
    i, rest, base = F.col(id_col) if isinstance(id_col, str) else id_col, n % parts, n // parts
    if base == 0:
        return i.cast("bigint")
    low = F.floor(i / (base + 1))
    return F.when(i < rest * (base + 1), low).otherwise(rest + F.floor((i - rest * (base + 1)) / base)).cast("bigint")


def all_pairs(spark, parts: int) -> DataFrame:
    """(i, j), i < j, of partition numbers."""
    r = spark.range(parts)
    return r.select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(parts))).alias("j")).filter(F.col("j") < parts)


def allowed_pairs(lines: DataFrame, parts: int) -> DataFrame:
    """Unordered pairs from text lines "i j"; # begins a comment, blank lines don't count, anything else is an error."""
    text = F.trim(F.regexp_replace("value", "#.*$", ""))
    fields = F.split(text, r"\s+")
    good = (F.size(fields) == 2) & text.rlike(r"^\d+\s+\d+$") & (F.get(fields, 0) != F.get(fields, 1)) & (F.get(fields, 0).try_cast("bigint") < parts) & (F.get(fields, 1).try_cast("bigint") < parts)
    checked = lines.filter(text != "").select(F.when(good, fields).otherwise(F.raise_error(F.concat(F.lit("not a pair of partitions: "), "value"))).alias("f"))
    i, j = F.col("f")[0].cast("bigint"), F.col("f")[1].cast("bigint")
    return checked.select(F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).distinct()


def hash_sample(df: DataFrame, id_col: str, share: float, seed: int = 0) -> DataFrame:
    """Each row with probability share, decided by its id's hash: the same rows wherever and however often it is run."""
    return df.filter(F.md5(F.concat_ws(":", F.lit(seed), id_col)) < f"{int(share * 2**32):08x}" if share < 1 else F.lit(True))


def fixed_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, those with the least hashes of their ids."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), id_col)), id_col).limit(n)


def nearest_centres(df: DataFrame, centres: list[tuple[int, list[float]]], k: int = 1, vec_col: str = "embedding") -> DataFrame:
    """df with nearest: array of (dist, centre), the k nearest of few centres; ties go to the lower centre. No row moves; rows without a
    vector go."""
    ordered = sorted((int(c), v) for c, v in centres)
    sent = df.sparkSession.sparkContext.broadcast((np.array([c for c, _ in ordered]), np.array([v for _, v in ordered], dtype=np.float64)))
    at, names = df.columns.index(vec_col), [*df.columns, "nearest"]
    kind = T.ArrayType(T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("centre", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = sent.value
        most = min(k, len(ids))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(at))
                d = np.stack([exact("l2", one, x) for one in c], axis=1)
                order = np.argsort(d, axis=1, kind="stable")[:, :most]
                pairs = pa.StructArray.from_arrays([pa.array(d[np.arange(len(x))[:, None], order].ravel()), pa.array(ids[order.ravel()])], names=["dist", "centre"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * most + 1, most), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=names)

    return df.filter(F.col(vec_col).isNotNull()).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("nearest", kind)]))


def capped_assignment(near: DataFrame, cap: int, slack: float = 1.1, copies: int = 2) -> DataFrame:
    """(id, centre): each row goes to its nearest centres (near: id, nearest array<struct<dist, centre>>, sorted) while a

    distance is at most slack times the mean of those it took and the centre has
    room for cap rows; a full centre starts the mean anew; at most so many copies.
    The outcome depends on the order of rows by definition, so rows of ids and
    distances (not vectors) pass one task in order of id, as a stream: its memory
    is a counter for each centre. A row that finds no room is an error.
    """
    def run(batches):
        used: dict[int, int] = {}
        for pdf in batches:
            rows = []
            for i, options in zip(pdf["id"], pdf["nearest"], strict=True):
                taken, mean = 0, float("inf")
                for o in options:
                    if taken == copies or o["dist"] > slack * mean:
                        break
                    if used.get(o["centre"], 0) >= cap:
                        mean = float("inf")
                        continue
                    used[o["centre"]] = used.get(o["centre"], 0) + 1
                    rows.append((i, o["centre"]))
                    mean = o["dist"] if taken == 0 or mean == float("inf") else (mean * taken + o["dist"]) / (taken + 1)
                    taken += 1
                if not taken:
                    raise ValueError(f"no centre has room for row {i}")
            yield pd.DataFrame(rows, columns=["id", "centre"])

    return near.select("id", "nearest").repartition(1).sortWithinPartitions("id").mapInPandas(run, "id bigint, centre bigint")


def kmeans_shards(df: DataFrame, centres: np.ndarray, copies: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, shard, rank, dist): each row with its `copies` nearest centres, in order; ties go to the lower number. Centres are sent to the
    tasks (a bounded number, by the budget); no row moves."""
    if not 1 <= copies <= len(centres):
        raise ValueError("copies must be between 1 and the number of centres")
    sent = df.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            d = np.stack([exact("l2", one, x) for one in c], axis=1)
            order = np.argsort(d, axis=1, kind="stable")[:, :copies]
            n = len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), copies), pa.int64()), pa.array(order.ravel()), pa.array(np.tile(np.arange(copies), n).astype(np.int32)), pa.array(d[np.arange(n)[:, None], order].ravel())],
                                             names=["id", "shard", "rank", "dist"])

    return df.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInArrow(run, "id bigint, shard bigint, rank int, dist double")


#: How many partial sums a task adds up.
ADDED = 64


def added_up(parts: DataFrame) -> np.ndarray | None:
    """The sums of rows (adder, sums binary): flat numbers, a row for each task, with adder its number. In levels of ADDED, so that no task reads them all."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["sums"])
        return pd.DataFrame({"adder": pdf["adder"].iloc[:1] // ADDED, "sums": [total.tobytes()]})

    kind = "adder bigint, sums binary"
    for _ in range(2):
        parts = parts.withColumn("adder", F.floor(F.col("adder") / ADDED)).groupBy("adder").applyInPandas(add, kind)
    row = parts.withColumn("adder", F.lit(0).cast("bigint")).groupBy("adder").applyInPandas(add, kind).first()
    return None if row is None else np.frombuffer(row.sums)


def sums_of(rows: DataFrame, k: int, dim: int, measured: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(centres' sums, numbers of rows, residual) over rows. measured: vectors of a batch, their centres and their squared distances from these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, residual = np.zeros((k, dim)), np.zeros(k), 0.0
        for b in batches:
            if b.num_rows:
                x, near, d = measured(b)
                np.add.at(sums, near, x)
                n += np.bincount(near, minlength=k)
                residual += float(d.sum())
        flat = np.concatenate([sums.ravel(), n, [residual]])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["adder", "sums"])

    flat = added_up(rows.mapInArrow(run, "adder bigint, sums binary"))
    if flat is None:
        flat = np.zeros(k * dim + k + 1)
    return flat[: k * dim].reshape(k, dim), flat[k * dim:-1], float(flat[-1])


def moved(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Means; a centre without rows becomes zero."""
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], 0.0)


def all_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([exact("l2", one, x) for one in centres], axis=1)


def lloyd_step(df: DataFrame, centres: np.ndarray, vec_col: str = "embedding") -> tuple[np.ndarray, float]:
    """One round of k-means over all rows: new centres, and the residual under the old ones. A task returns one row of sums."""
    sent = df.sparkSession.sparkContext.broadcast(centres)

    def measured(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = matrix(b.column(0))
        d = all_distances(x, sent.value)
        near = d.argmin(axis=1)
        return x, near, d[np.arange(len(x)), near]

    sums, n, residual = sums_of(df.filter(F.col(vec_col).isNotNull()).select(vec_col), len(centres), centres.shape[1], measured)
    return moved(sums, n), residual


def settled(residuals: list[float]) -> bool:
    """Whether the residual has become nothing, or fell by under 1e-5 of what it has become."""
    return residuals[-1] < 2.2e-16 or len(residuals) > 1 and (residuals[-2] - residuals[-1]) / residuals[-1] < 1e-5


def kmeans(df: DataFrame, centres: np.ndarray, rounds: int = 12, vec_col: str = "embedding") -> tuple[np.ndarray, list[float]]:
    """Lloyd's iteration over all rows, and the residuals. Stops when the residual falls by under 1e-5 of what it has become; a centre
    without rows becomes zero."""
    residuals: list[float] = []
    for _ in range(rounds):
        centres, residual = lloyd_step(df, centres, vec_col)
        residuals.append(residual)
        if settled(residuals):
            break
    return centres, residuals


BOUNDS = "vec array<double>, near int, upper double, lower double, dist double, asked bigint"


def kmeans_by_bounds(df: DataFrame, centres: np.ndarray, rounds: int = 12, vec_col: str = "embedding") -> tuple[np.ndarray, list[float], int]:
    """kmeans() by the triangle inequality, and how many distances were computed: the same centres.

    Between rounds a table has for each row its centre, a bound from above of the distance from it, and one from below of that from any
    other. When centres move the bounds give way by as much; only where they overlap are distances computed, to all centres.
    The residual takes one distance a row and round.
    """
    rows = df.filter(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("vec"))
    table = rows.select("vec", F.lit(-1).alias("near"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0.0).alias("dist"), F.lit(0).cast("bigint").alias("asked"))
    k, dim = centres.shape
    residuals, asked, moves, before = [], 0, np.zeros(k), None
    for _ in range(rounds):
        between = np.sqrt(np.maximum(all_distances(centres, centres), 0))
        np.fill_diagonal(between, np.inf)
        sent = df.sparkSession.sparkContext.broadcast((centres, moves, between.min(axis=1) / 2 if k > 1 else np.full(k, np.inf)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            centres, moves, half = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                x, near, lower = matrix(b.column(0)), b.column(1).to_numpy().copy(), b.column(3).to_numpy() - moves.max(initial=0)
                new, asked = near < 0, np.ones(len(near), dtype=np.int64)
                own = np.where(new, 0, near)
                dist = ((x - centres[own]) ** 2).sum(axis=1)
                upper = np.sqrt(dist)
                open_ = np.flatnonzero(new | (upper >= np.maximum(lower, half[own])))
                if len(open_):
                    d = all_distances(x[open_], centres)
                    best = d.argmin(axis=1)
                    near[open_], dist[open_] = best, d[np.arange(len(open_)), best]
                    upper[open_] = np.sqrt(dist[open_])
                    d[np.arange(len(open_)), best] = np.inf
                    lower[open_] = np.sqrt(d.min(axis=1))
                    asked[open_] += d.shape[1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(dist), pa.array(asked)], names=["vec", "near", "upper", "lower", "dist", "asked"])

        table = stored(table.mapInArrow(run, BOUNDS), "bounds")
        if before is not None:
            discard(before)
        before = table
        asked += table.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
        sums, n, residual = sums_of(table.select("vec", "near", "dist"), k, dim, lambda b: (matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()))
        new = moved(sums, n)
        moves, centres = np.sqrt(((new - centres) ** 2).sum(axis=1)), new
        residuals.append(residual)
        if settled(residuals):
            break
    if before is not None:
        discard(before)
    return centres, residuals, asked


def seeds(df: DataFrame, k: int, rounds: int = 5, share: float = 2.0, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0) -> np.ndarray:
    """k first centres by oversampled D-squared seeding over all rows: in each round every row joins the candidates with a chance of

    share * k times its share of the residual, by a hash of its id; the candidates, about rounds * share * k of them, are weighed
    by the rows nearest to them, and k of them are chosen by D-squared seeding with these weights.
    """
    rows = df.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col)
    own = random_pivots(df, 1, id_col, vec_col, seed)
    context, dim = df.sparkSession.sparkContext, own.shape[1]

    def nearest(sent):
        def measured(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = matrix(b.column(0))
            d = all_distances(x, sent.value)
            return x, d.argmin(axis=1), d.min(axis=1)

        return measured

    for n in range(rounds):
        sent = context.broadcast(own)
        _, _, residual = sums_of(rows.select(vec_col), len(own), dim, nearest(sent))
        if residual <= 0:
            break

        def pick(batches: Iterator[pa.RecordBatch], sent=sent, residual=residual) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = all_distances(matrix(b.column(0)), sent.value).min(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0).filter(c := pa.array(b.column(1).to_numpy() * residual < share * k * d)), b.column(2).filter(c)], names=["vec", "h"])

        draw = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}.{n}"), id_col)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
        found = rows.select(F.col(vec_col).cast("array<double>").alias("vec"), draw.alias("draw"), F.md5(F.concat_ws(":", F.lit(seed), id_col)).alias("h")).mapInArrow(pick, "vec array<double>, h string").orderBy("h").collect()
        if found:
            own = np.vstack([own, *[np.array(r.vec)[None] for r in found]])
    own = np.array(list(dict.fromkeys(map(tuple, own))))
    if len(own) < k:
        return random_pivots(df, k, id_col, vec_col, seed)
    _, weight, _ = sums_of(rows.select(vec_col), len(own), dim, nearest(context.broadcast(own)))
    rng, chosen = np.random.default_rng(seed), [int(weight.argmax())]
    d = ((own - own[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        mass = weight * d if (weight * d).sum() > 0 else d
        chosen.append(int(rng.choice(len(own), p=mass / mass.sum())))
        d = np.minimum(d, ((own - own[chosen[-1]]) ** 2).sum(axis=1))
    return own[chosen]


def random_pivots(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0) -> np.ndarray:
    """k rows as first centres, those with the least hashes of their ids, equal vectors once."""
    rows = fixed_sample(df.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col), id_col, 4 * k, seed).collect()
    distinct = list(dict.fromkeys(tuple(r[1]) for r in sorted(rows, key=lambda r: hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest())))[:k]
    if len(distinct) < k:
        raise ValueError(f"{len(distinct)} different rows are too few for {k} centres")
    return np.array(distinct, dtype=np.float64)


def budget_shards(df: DataFrame, budget: float, copies: int = 2, degree: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", first: int = 3, step: int = 2, retries: int = 32, fraction: float = 0.95, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(the written shards of kmeans_shards(), their centres) such that a graph of any shard fits the budget: from `first` shards on, `step` more
    until the actual largest one fits `fraction` of it."""
    dim = df.agg(F.max(F.size(vec_col))).first()[0] or 1
    most, k = largest_shard(dim, budget, degree, fraction=fraction), max(first, copies)
    for _ in range(retries):
        centres, _ = kmeans(df, random_pivots(df, k, id_col, vec_col, seed), 10, vec_col)
        shards = stored(kmeans_shards(df, centres, copies, id_col, vec_col), "shards")
        largest = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= most:
            return shards, centres
        k += step
    raise ValueError(f"after {retries} attempts the largest of {k - step} shards has {largest} rows, and {most} fit")


def materialised(shards: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(shard, local, id, vec): each shard's rows, numbered within it in order of id."""
    from pyspark.sql import Window

    own = shards.select("id", "shard").join(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "id")
    return own.withColumn("local", F.row_number().over(Window.partitionBy("shard").orderBy("id")) - 1).select("shard", "local", "id", "vec")


def to_global(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst) under global ids of shards' edges (shard, src, dst) under local ones; ids: (shard, local, id)."""
    name = lambda c: ids.select("shard", F.col("local").alias(c), F.col("id").alias(f"global_{c}"))
    return edges.join(name("src"), ["shard", "src"]).join(name("dst"), ["shard", "dst"]).select(F.col("global_src").alias("src"), F.col("global_dst").alias("dst"))


def shard_labels(shards: DataFrame, labels: DataFrame) -> DataFrame:
    """(shard, id, labels) of the rows of each shard; labels: (id, labels)."""
    return shards.select("shard", "id").join(labels, "id").select("shard", "id", "labels")


def centroids(assigned: DataFrame, by: str, vec_col: str = "embedding") -> DataFrame:
    """(by, pos, mean): the mean of each group's vectors, a row for each dimension. Sums are made in each batch before anything moves."""
    kind = assigned.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            groups = b.column(0).dictionary_encode()
            at = groups.indices.fill_null(len(groups.dictionary)).to_numpy(zero_copy_only=False)
            k, dim = len(groups.dictionary) + groups.indices.null_count.__bool__(), x.shape[1]
            sums = np.zeros((k, dim))
            np.add.at(sums, at, x)
            n = np.bincount(at, minlength=k)
            keys = pa.concat_arrays([groups.dictionary, pa.nulls(k - len(groups.dictionary), groups.dictionary.type)])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(k), dim))), pa.array(np.tile(np.arange(dim), k).astype(np.int32)), pa.array(sums.ravel()), pa.array(np.repeat(n, dim).astype(np.int64))], names=["by", "pos", "s", "n"])

    own = assigned.filter(F.col(vec_col).isNotNull()).select(by, vec_col).mapInArrow(run, f"by {kind}, pos int, s double, n bigint")
    return own.groupBy(F.col("by").alias(by), "pos").agg((F.sum("s") / F.sum("n")).alias("mean"))
