"""Quality classifier on random Fourier features (operator 10).

Statistics of the whole text are standardised and mapped to random Fourier
features, which approximate a Gaussian kernel. Each partition sums its part of
the normal equations, ridge regression solves them, and isotonic regression on
held-back labelled rows turns the raw score into a probability.

The fit uses at most about FIT_ROWS labelled rows, chosen by a hash of the id;
scoring covers every row.

Defined results: null or empty text is scored like any text, from zero counts;
a document labelled more than once counts by its highest label; rows with a null
id or label don't teach; with no labelled rows every score is 0.5; equal raw
scores get one calibrated score, of a block that has all of them; texts of any
length are read whole, one at a time; an empty
table gives an empty result; labels, lang, source and ids are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.quality_rules import DIGITS, LETTERS, SYMBOLS, UPPER, without
from orrery.llm.shared import SPACE, discard, encoded, slices, stored

FIT_ROWS = 40_000
FIT_PARTITIONS = 8
#: How many partitions' matrices a task adds up.
ADDED = 16
N_FEATURES = 256
RIDGE = 1e-3
SEED = 20240229
THRESHOLD = 0.7
PUNCTUATION = b".,;:'\"()-"
VOWELS = b"aeiouAEIOU"


def statistics(b: bytes) -> list[float]:
    w = b.split()
    n, size = max(len(w), 1), max(len(b), 1)
    lines = [x for x in b.split(b"\n") if x.strip(SPACE)]
    m = max(len(lines), 1)
    pairs = max(len(w) - 1, 1)
    word_bytes = size - without(b, SPACE)
    letters = without(b, LETTERS)
    return [
        np.log1p(len(w)), word_bytes / n, without(b, SYMBOLS) / n, without(b, UPPER) / max(letters, 1), without(b, DIGITS) / size,
        without(b, b"!?") / n, without(b, PUNCTUATION) / n, letters / size, without(b, VOWELS) / max(letters, 1),
        1 - len(set(w)) / n, 1 - len(set(zip(w, w[1:], strict=False))) / pairs if len(w) > 1 else 0.0,
        1 - len(set(lines)) / m if lines else 0.0, np.log1p(len(lines)), np.log1p(n / m), max(map(len, w), default=0) ** 0.5,
        sum(x.rstrip(SPACE)[-1:] in b".!?" for x in lines) / m, without(b, b"/@_=") / n, without(b, b"{}[]()") / n,
    ]


N_STATISTICS = len(statistics(b""))


def table(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(x) for x in encoded(texts)], dtype=np.float64).reshape(-1, N_STATISTICS)


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATISTICS), pa.int32()), pa.array(x.ravel()))


class Model:
    """Standardisation, random features, ridge weights and the calibration's knots."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), N_FEATURES)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, N_FEATURES)
        self.beta = np.zeros(N_FEATURES + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / N_FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit by pooling adjacent violators; between knots it is linear.

    Each block counts one imagined label of either kind, so that no score is
    surely 0 or 1.
    """
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, number, sum of scores
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([y, 1, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], a, strict=True)]
    y = np.maximum.accumulate(np.array([(b[0] + 1e-3) / (b[1] + 2e-3) for b in blocks]))
    x = np.array([b[2] / b[1] for b in blocks])
    # Ends: a little slope beyond the last knots keeps the order of extreme scores.
    x = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    return x, np.concatenate([[y[0] * 0.9], y, [1 - (1 - y[-1]) * 0.9]])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)


def fit(taught: DataFrame) -> Model:
    """A model from rows (x, y, calibrate, deal): some fit the weights, the others calibrate. deal spreads equal rows."""
    taught = taught.repartition(FIT_PARTITIONS, "deal")
    moments = taught.select(F.posexplode("x"), F.lit(1)).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    if not moments:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    model = Model(np.array([r.m for r in moments]), np.array([max(r.s, 1e-9) for r in moments]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_FEATURES + 1, N_FEATURES + 2))
        for b in batches:
            if b.num_rows:
                f = model.features(matrix(b.column(0)))
                total += f.T @ np.hstack([f, b.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // ADDED]), pa.array([total.tobytes()], pa.binary())], names=["adder", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(1):
                one = np.frombuffer(x.as_buffer()).reshape(N_FEATURES + 1, N_FEATURES + 2)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["adder", "sums"])

    parts = taught.filter("NOT calibrate").select("x", "y").mapInArrow(sums, "adder bigint, sums binary")
    # In two levels, so that no task reads all matrices: one for ADDED partitions, and one for what they have added up.
    parts = parts.repartition(F.col("adder")).mapInArrow(added, "adder bigint, sums binary")
    row = parts.repartition(1).mapInArrow(added, "adder bigint, sums binary").first()
    total = np.frombuffer(row.sums).reshape(N_FEATURES + 1, N_FEATURES + 2)
    a = total[:, :-1]
    n = max(a[-1, -1], 1.0)
    penalty = np.full(N_FEATURES + 1, RIDGE * n)
    penalty[-1] = 1e-9
    model.beta = np.linalg.solve(a + np.diag(penalty / N_FEATURES), total[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(matrix(b.column(0)))), b.column(1)], names=["raw", "y"])

    held = taught.filter("calibrate").select("x", "y").mapInArrow(raw, "raw double, y double").toPandas()  # a part of the bounded sample
    if len(held):
        model.knots = isotonic(held["raw"].to_numpy(), held["y"].to_numpy())
    return model


def may_teach(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    known = labels.filter(F.col("quality").isNotNull() & may_teach(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("__y"))
    rows = known.count()
    if rows > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int((1 << 20) * fit_rows / rows))
    # About fit_rows ids and labels at most, whatever the input: small enough to send everywhere.
    known = F.broadcast(known.withColumnRenamed("doc_id", id_col).withColumn("__calibrate", F.pmod(F.xxhash64(id_col), F.lit(4)) == 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([as_lists(table(b.column(0))), *b.columns[1:]], names=["x", "y", "calibrate", "deal"])

    rows = docs.select(id_col, text_col).join(known, id_col).select(text_col, "__y", "__calibrate", F.xxhash64(id_col))
    taught = stored(rows.mapInArrow(run, "x array<double>, y double, calibrate boolean, deal bigint"), "taught")
    model = fit(taught)
    discard(taught)
    return model


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """The carried columns and the score, one row for each row of docs; no row moves."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.score(table(b.column(0))))], names=[*carry, out])

    return docs.select(F.col(text_col).alias("__text"), *carry).mapInArrow(run, f"{fields}, `{out}` double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs."""
    scored = score(docs, train(docs, labels, id_col, text_col, fit_rows), [id_col], text_col)
    return scored.select(
        F.col(id_col).alias("doc_id"), (~may_teach(F.col(id_col)) & F.col(id_col).isNotNull()).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
