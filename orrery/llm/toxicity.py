"""Toxicity from the nearest labelled examples (operator 13).

A text is a TF-IDF vector over a vocabulary of words and beginnings of words, as
compounds often share one, that go with either label in the examples (FEATURE_Z
standard errors or more), and of one more term, `other`, for all words that have
none of these. So what is long and mentions a term once lies near clean texts.
Inverse document frequencies are counted over all documents.

The examples' vectors are indexed by term. Example numbers are cut into blocks
of BLOCK, the same for all terms, and for each term and block the largest weight
is kept. A query's bound for a block is the sum of its own weights times these;
blocks are opened from the highest bound down, and exact cosines computed from
their entries' own terms, until the K-th best cosine exceeds what is left. No example that could be among the K
nearest is left out. Examples with equal vectors are one entry that counts as
often as there are. The nearest K examples vote, a vote's weight falling with
the distance, and isotonic regression on labelled rows that aren't in the index
turns the vote into a probability.

The examples and the calibration rows are at most about FIT_ROWS labelled rows,
chosen by a hash of the id, so the index is bounded and sent to all tasks; every
row is scored. Each text is cut into terms once, and its terms are written.

Defined results: null or empty text is scored like any text, and has no terms: it
is as far from all examples, and its vote is the share of toxic examples; of
labels of one id the highest counts; rows with a null id or label don't teach;
repeated rows teach and are scored each; examples that tie at the K-th place
share it; texts of any length are taken whole; without labelled rows every score
is 0.5; an empty table gives an empty result; labels, lang, source and ids are
never inputs; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.quality_classifier import isotonic
from orrery.llm.shared import discard, slices, stored

FIT_ROWS = 20_000
#: A term belongs to the vocabulary if its share among toxic and other examples differs by so many standard errors, and if so many examples have it.
FEATURE_Z, LEAST_EXAMPLES = 6.0, 5
#: The vocabulary's size at most; the terms that differ most.
VOCABULARY = 8192
#: Beginnings of words that are terms, by length.
BEGINNINGS = range(3, 9)
K, BLOCK = 24, 32
#: Blocks that a query opens at first.
OPENED = 4
#: What is added to a distance before it divides a vote.
NEAR = 0.02
THRESHOLD = 0.5
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words that a task remembers the terms of.
REMEMBERED = 1 << 17
#: The number of the term that stands for words with no term of the vocabulary.
OTHER = 0


def words(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def terms(word: str) -> list[str]:
    """The word itself, and its beginnings, which end in * and are shorter."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if n < len(word))]


class Vocabulary:
    """Numbers of the chosen terms, from 1; 0 is OTHER."""

    def __init__(self, chosen: list[str]):
        self.number = {t: n for n, t in enumerate(chosen, start=1)}
        self.size = len(chosen) + 1
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        own = self.known.get(word)
        if own is None:
            own = tuple(n for t in terms(word) if (n := self.number.get(t)) is not None) or (OTHER,)
            if len(self.known) < REMEMBERED:
                self.known[word] = own
        return own

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each term occurs in a text, in the terms' order."""
        out: dict[int, int] = {}
        for word, n in words(text).items():
            for t in self.of(word):
                out[t] = out.get(t, 0) + n
        return dict(sorted(out.items()))


def unit(numbers: list[int], counts: list[int], idf: np.ndarray) -> np.ndarray:
    """The weights of a vector of length 1."""
    w = (1 + np.log(np.array(counts, dtype=float))) * idf[numbers]
    return w / np.linalg.norm(w)


class BlockMaxIndex:
    """Entries (vector, examples, toxic examples): by term the blocks that have it, with the term's largest weight in each; and by block the

    entries' own terms and weights. Entries are told apart and ordered by vector, so that alike ones share blocks.
    """

    def __init__(self, size: int, entries: list[tuple[list[int], np.ndarray, int, int]], k: int = K, block: int = BLOCK):
        self.k, self.block, self.n, self.size = k, block, len(entries), size
        self.examples = np.array([e[2] for e in entries], dtype=np.int64)
        self.toxic = np.array([e[3] for e in entries], dtype=np.int64)
        self.rate = float(self.toxic.sum() / self.examples.sum()) if self.n else 0.5
        lengths = [len(e[0]) for e in entries]
        self.ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.term = np.array([t for e in entries for t in e[0]], dtype=np.int64)
        self.weight = np.concatenate([np.zeros(0), *(e[1] for e in entries)])
        self.blocks = -(-self.n // block)
        at = np.repeat(np.arange(self.n), lengths) // block if self.n else np.zeros(0, dtype=np.int64)
        by = np.lexsort((at, self.term))
        term, at, weight = self.term[by], at[by], self.weight[by]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (at[1:] != at[:-1])])) if len(term) else np.zeros(0, dtype=np.int64)
        self.most = np.maximum.reduceat(weight, first) if len(first) else weight
        self.most_block, starts = at[first], np.searchsorted(term[first], np.arange(size + 1))
        self.of_term = list(zip(starts.tolist(), starts[1:].tolist(), strict=False))

    def cosines(self, blocks: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of some blocks, and their cosines with a dense query."""
        entries = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
        entries = entries[entries < self.n]
        starts, ends = self.ends[entries], self.ends[entries + 1]
        sizes = ends - starts
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - starts, sizes)
        return entries, np.round(np.add.reduceat(query[self.term[at]] * self.weight[at], cuts[:-1]), 12)

    def nearest(self, numbers: list[int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entries with the k nearest examples among them, and all that tie with the last, and their cosines, the nearest first; and how many

        blocks were opened: those of the highest bounds, OPENED and then twice as many a time, until the k-th cosine exceeds all other bounds.
        """
        bound, query = np.zeros(self.blocks), np.zeros(self.size)
        query[numbers] = weights
        for t, w in zip(numbers, weights.tolist(), strict=True):
            lo, hi = self.of_term[t]
            bound[self.most_block[lo:hi]] += w * self.most[lo:hi]
        order = np.argsort(-bound, kind="stable")
        best, cosines, opened, step, least = np.zeros(0, dtype=np.int64), np.zeros(0), 0, OPENED, -1.0
        while opened < self.blocks:
            some = order[opened:opened + step]
            some = some[bound[some] + 1e-9 >= least]
            if not len(some):
                break
            entries, own = self.cosines(some, query)
            keep = own >= least
            best, cosines = np.concatenate([best, entries[keep]]), np.concatenate([cosines, own[keep]])
            by = np.lexsort((best, -cosines))
            best, cosines = best[by], cosines[by]
            enough = np.cumsum(self.examples[best])
            if enough[-1] >= self.k:  # what ties with the last place stays
                least = cosines[np.searchsorted(enough, self.k)]
                stay = int(np.searchsorted(-cosines, -least, side="right"))
                best, cosines = best[:stay], cosines[:stay]
            opened, step = opened + len(some), 2 * step
        return best, cosines, opened

    def vote(self, numbers: list[int], weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The toxic share of the k nearest examples' votes, and the entries and cosines that it comes from."""
        if not self.n or not len(numbers):
            return self.rate, np.zeros(0, dtype=np.int64), np.zeros(0)
        best, cosines, _ = self.nearest(numbers, weights)
        examples, last = self.examples[best].astype(float), cosines[-1]
        ties = cosines == last
        # Those that tie with the last place share the places that are left.
        examples[ties] *= min(1.0, max(self.k - examples[~ties].sum(), 0.0) / examples[ties].sum())
        weight = examples / (NEAR + 1 - np.minimum(cosines, 1.0))
        return float((weight * self.toxic[best] / self.examples[best]).sum() / weight.sum()), best, cosines


class Model:
    """The terms' idf, the index, the calibration's knots, and an example's id for each entry."""

    def __init__(self, idf: np.ndarray, index: BlockMaxIndex, ids: list):
        self.idf, self.index, self.ids = idf, index, ids
        self.knots = (np.array([0.0]), np.array([0.5]))

    def score(self, vote: float) -> float:
        return float(np.interp(vote, *self.knots))


def may_teach(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 != 0, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fit_rows: int) -> DataFrame:
    """A written table (id, text, y, calibrate) of at most about fit_rows labelled rows that may teach."""
    known = labels.filter(F.col("toxic").isNotNull() & may_teach(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    rows = known.count()
    if rows > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) < int((1 << 20) * fit_rows / rows))
    # About fit_rows ids and labels, whatever the input: small enough to send everywhere.
    known = F.broadcast(known.select(F.col("doc_id").alias("id"), "y", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrate")))
    return stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id"), "examples")


def choose(taught: DataFrame) -> list[str]:
    """The vocabulary: terms whose share among toxic and other examples differs, the most different first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found: dict[str, list[int]] = {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in {t for w in words(text) for t in terms(w)}:
                    found.setdefault(t, [0, 0])[y != 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([n for _, n in found.values()], pa.int64())], names=["term", "clean", "toxic"])

    learn = taught.filter("NOT calibrate")
    sizes = learn.agg(F.sum((F.col("y") == 0).cast("int")).alias("c"), F.sum((F.col("y") != 0).cast("int")).alias("t")).first()
    if not sizes.c or not sizes.t:
        return []
    # Copies of a text count once, so that one text with many doesn't bring its words in.
    distinct = learn.groupBy(F.xxhash64("text"), "text").agg(F.max("y").alias("y")).select("text", "y")
    sums = distinct.mapInArrow(run, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n_c, n_t = float(sizes.c), float(sizes.t)
    p = (F.col("clean") + F.col("toxic")) / (n_c + n_t)
    z = F.abs(F.col("toxic") / n_t - F.col("clean") / n_c) / F.sqrt(p * (1 - p) * (1 / n_c + 1 / n_t) + 1e-12)
    chosen = sums.filter(F.col("clean") + F.col("toxic") >= LEAST_EXAMPLES).withColumn("z", F.round(z, 9)).filter(F.col("z") >= FEATURE_Z)
    return [r.term for r in chosen.orderBy(F.desc("z"), "term").limit(VOCABULARY).collect()]


VECTOR = "numbers array<int>, counts array<int>"


def vectors(rows: DataFrame, vocabulary: Vocabulary, carry: list[str]) -> DataFrame:
    """The carried columns and a text's terms with their counts."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [vocabulary.counts(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([list(x) for x in own], pa.list_(pa.int32())), pa.array([list(x.values()) for x in own], pa.list_(pa.int32()))], names=[*carry, "numbers", "counts"])

    return rows.select("text", *carry).mapInArrow(run, f"{fields}, {VECTOR}" if carry else VECTOR)


def frequencies(vectors_: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many rows of a written table of vectors each term is, and their number."""
    found = vectors_.select(F.explode("numbers").alias("t")).groupBy("t").count().collect()  # at most VOCABULARY + 1 rows
    df = np.zeros(size)
    for r in found:
        df[r.t] = r["count"]
    return df, vectors_.count()


def train(vectors_: DataFrame, taught: DataFrame, vocabulary: Vocabulary) -> Model:
    """vectors_: of all documents, written; they give the idf."""
    df, n = frequencies(vectors_, vocabulary.size)
    idf = np.log((1 + n) / (1 + df)) + 1
    known = stored(vectors(taught, vocabulary, ["id", "y", "calibrate"]), "example-vectors")
    entries: dict[tuple, list] = {}
    for r in known.filter("NOT calibrate").collect():  # about FIT_ROWS rows at most, without texts
        if len(r.numbers):
            w = unit(r.numbers, r.counts, idf)
            e = entries.setdefault((tuple(r.numbers), tuple(np.round(w, 9).tolist())), [r.numbers, w, 0, 0, r.id])
            e[2], e[3], e[4] = e[2] + 1, e[3] + (r.y != 0), min(e[4], r.id)
    ordered = [entries[k] for k in sorted(entries)]
    model = Model(idf, BlockMaxIndex(vocabulary.size, [tuple(e[:4]) for e in ordered]), [e[4] for e in ordered])
    # Their votes come from tasks, as those of all documents; a pair of numbers for each of a bounded number of rows is collected.
    held = voted(known.filter("calibrate").select("y", "numbers", "counts"), model, "y").select("id", "vote").toPandas()
    if len(held):
        vote, toxic = np.round(held["vote"].to_numpy(), 12), (held["id"] != 0).to_numpy().astype(float)
        by = np.lexsort((-toxic, vote))  # falling among equal votes, so that these become one block, however the rows came
        model.knots = isotonic(vote[by], toxic[by])
    discard(known)
    return model


def voted(rows: DataFrame, model: Model, id_col: str) -> DataFrame:
    """(id, score, vote, evidence) of rows (id_col, numbers, counts). The model, of bounded size, goes to all tasks; no row moves."""
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    sent, ids = spark.sparkContext.broadcast(model), "bigint" if not model.ids or isinstance(model.ids[0], int) else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = sent.value, {}
        item = pa.struct([("id", pa.int64() if ids == "bigint" else pa.string()), ("cosine", pa.float64()), ("examples", pa.int64()), ("toxic", pa.int64())])
        for b in slices(batches):
            out = []
            for numbers, counts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                key = (tuple(numbers), tuple(counts) if len(numbers) > 1 else ())  # of one term alone the count doesn't matter
                if key not in seen:
                    vote, best, cosines = model.index.vote(numbers, unit(numbers, counts, model.idf) if numbers else np.zeros(0))
                    evidence = [{"id": model.ids[i], "cosine": float(c), "examples": int(model.index.examples[i]), "toxic": int(model.index.toxic[i])} for i, c in zip(best[:5], cosines[:5], strict=True)]
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[key] = (model.score(vote), vote, evidence)
                out.append(seen[key])
            score, vote, evidence = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(vote, pa.float64()), pa.array(evidence, pa.list_(item))], names=["id", "score", "vote", "evidence"])

    return rows.mapInArrow(run, f"id {kind}, score double, vote double, evidence array<struct<id:{ids},cosine:double,examples:bigint,toxic:bigint>>")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row for each row of docs. evidence: up to five of the nearest entries, by an

    example's id, its cosine, and how many examples have its vector and how many of them are toxic.
    """
    taught = examples(docs, labels, id_col, text_col, fit_rows)
    vocabulary = Vocabulary(choose(taught))
    own = stored(vectors(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), vocabulary, ["id"]), "vectors")
    model = train(own, taught, vocabulary)
    scored = voted(own, model, "id")
    discard(taught)
    return scored.select(
        F.col("id").alias("doc_id"), (~may_teach(F.col("id")) & F.col("id").isNotNull()).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
