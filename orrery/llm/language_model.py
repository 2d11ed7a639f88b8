"""N-gram scoring by a weighted backoff automaton (operator 7).

The model has every n-gram of up to ORDER words that training texts hold, with
Dirichlet smoothing: a history h that was seen gives a word w the probability
(c(hw) + m p(w | shorter h)) / (c(h) + m), where m is the order's STRENGTH, and
the empty history gives the add-one unigram. Nothing is cut by count. As an
automaton: every seen history is a state, with an arc for each word seen after
it, and a failure arc of the weight m / (c(h) + m) to the history without its
first word; the root has an arc for every word. A text is scored in one
traversal from left to right that carries the state and adds log10 weights.

No model is sent everywhere. Texts become blocks of about BLOCK_TOKENS tokens in
shared storage, with a vocabulary of their own. A block's distinct words, and
then its distinct n-grams order by order under 64-bit hashes, are added up over
blocks as packed lists (exchange.py), and the totals come back to the block; so
a task holds one block's part of the model. An n-gram need not be sent if no
other block has some part of it: then none has the n-gram, and the count at hand
is whole. Words are told apart by their bytes, n-grams by
their hashes: n of them share a count with some other with a chance of about
n / 2^64 each.

Defined results: null or empty text has the end token alone; rows with a null id
teach (they aren't held out); repeated rows count each; without training rows
every token has probability 1 under the base formula; an empty table gives an
empty result; other columns are ignored; texts of any length are one sequence of
tokens, of which a block holds all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.exchange import LISTS, numbered_keys, numbered_words, of_blocks, packed_lists, shards_for, squeezed, totals, unpacked_totals, unsqueezed
from orrery.llm.shared import LOWER, Out, discard, encoded, for_arrow, remove, scratch, shuffle_partitions, slices, stored

ORDER = 3
#: By the history's number of words: how many occurrences the shorter history's estimate weighs.
STRENGTH = (0.0, 50.0, 5.0)
BLOCK_TOKENS = 1 << 19
END = b""  # no word is empty


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


# -- n-grams of a block ---------------------------------------------------------------
def word_keys(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def joined_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a sequence from that of its beginning and that of its last word."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finaliser of SplitMix64
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Grams:
    """A block's distinct n-grams of one order, ascending by key."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, shorter: np.ndarray):
        """keys: of the n-grams at the places at; shorter: by place, the number of the one shorter that begins there."""
        self.places = at
        self.keys, first, self.of = np.unique(keys, return_index=True, return_inverse=True)
        self.begin, self.rest = shorter[at[first]], shorter[at[first] + 1]  # without the last word, and without the first

    def counts(self, taught: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=taught[self.places], minlength=len(self.keys)).astype(np.int64)


def grams(ids: np.ndarray, last: np.ndarray, words: np.ndarray, order: int) -> list[Grams]:
    """For 2 to order words. ids: all tokens; last: which are ends of texts, over which no n-gram reaches; words: keys by id."""
    key, at, shorter, out = words[ids], np.arange(len(ids)), ids.astype(np.int64), []
    for n in range(2, order + 1):
        at = at[at < len(ids) - n + 1]
        at = at[~last[at + n - 2]]
        key[at] = joined_keys(key[at], words[ids[at + n - 1]])
        out.append(Grams(key[at], at, shorter))
        shorter[at] = out[-1].of
    return out


# -- blocks ---------------------------------------------------------------------------
BLOCKS = "block bigint, path string, n_words bigint, n_tokens bigint"
FILE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.list_(pa.int32()))])


def make_blocks(docs: DataFrame, folder: str) -> DataFrame:
    """docs (doc_id, held_out, text) as files of numbered tokens, the block's words, ascending by key, beside them. One row for each block."""
    folder = for_arrow(docs.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        numbers: dict[bytes, int] = defaultdict()
        texts: list[tuple[int | None, bool, np.ndarray]] = []
        tokens = 0

        def end() -> pa.RecordBatch:
            words = np.array(list(numbers), dtype=object)
            order = np.argsort(word_keys(words.tolist()), kind="stable")
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            sizes = np.array([len(x) for *_, x in texts])
            ids = rank[np.concatenate([x for *_, x in texts])]
            held = np.array([h for _, h, _ in texts], dtype=bool)
            path = f"{folder}/{part:06d}-{number:04d}.arrow"
            file = Out(path)
            with pa.ipc.new_stream(file.stream, FILE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array([i for i, *_ in texts], pa.int64()), pa.array(held), lists], schema=FILE))
            file.close()
            file = Out(f"{path}.words")
            file.write(squeezed(b" ".join(words[order])))
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in ((part << 20) + number, path, len(order), len(ids))], names=["block", "path", "n_words", "n_tokens"])

        for b in slices(batches):
            for doc_id, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoded(b.column(2)), strict=True):
                if not texts:
                    numbers = defaultdict()
                    numbers.default_factory = numbers.__len__
                    numbers[END]
                own = list(map(numbers.__getitem__, text.translate(LOWER).split()))
                own.append(0)
                texts.append((doc_id, held, np.array(own, dtype=np.int32)))
                tokens += len(own)
                if tokens >= BLOCK_TOKENS:
                    yield end()
                    number, tokens, texts = number + 1, 0, []
        if texts:
            yield end()

    return stored(docs.select("doc_id", "held_out", "text").mapInArrow(run, BLOCKS), "lm-blocks")


class Block:
    """A block's files, and what follows from them and from the totals that came back. Words are kept for an order of 1 alone."""

    def __init__(self, path: str, order: int):
        fs, inner = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(inner) as f:
            table = pa.ipc.open_stream(f).read_all().combine_chunks()
        with fs.open_input_stream(f"{inner}.words") as f:
            words = unsqueezed(f.read()).split(b" ")
        self.doc_id, self.held = table.column(0), table.column(1).to_numpy()
        lists = table.column(2).chunk(0)
        self.ids, self.sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        self.starts = np.cumsum(self.sizes) - self.sizes
        last = np.zeros(len(self.ids), dtype=bool)
        last[self.starts + self.sizes - 1] = True
        self.taught = ~np.repeat(self.held, self.sizes)
        self.keys = word_keys(words)
        self.words = words if order == 1 else None
        self.grams = grams(self.ids, last, self.keys, order)

    def resolved(self, answers: list[pa.Scalar]) -> tuple[list[np.ndarray], np.ndarray | None]:
        """The counts of words, and of n-grams order by order as far as answers go; and which n-grams of the next order must be asked for."""
        count, shared = unpacked_totals(answers[0])
        out = [count]
        for n, g in enumerate(self.grams, start=1):
            ask = shared[g.begin] & shared[g.rest]
            if n == len(answers):
                return out, ask
            count, shared = g.counts(self.taught), np.zeros(len(g.keys), dtype=bool)
            count[ask], shared[ask] = unpacked_totals(answers[n])
            out.append(count)
        return out, None


# -- adding up over blocks ------------------------------------------------------------
def _word_lists(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            block = Block(b.column(1)[0].as_py(), 1)
            yield packed_lists(b.column(0)[0].as_py(), block.keys, np.bincount(block.ids[block.taught], minlength=len(block.keys)), shards, block.words)

    return blocks.select("block", "path").mapInArrow(run, LISTS)


def _gram_lists(work: DataFrame, shards: int) -> DataFrame:
    """Of the order that follows those that work (block, path, answers...) has totals of."""
    answered = len(work.columns) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            block = Block(b.column(1)[0].as_py(), answered + 1)
            g, (_, ask) = block.grams[-1], block.resolved([c[0] for c in b.columns[2:]])
            yield packed_lists(b.column(0)[0].as_py(), g.keys[ask], g.counts(block.taught)[ask], shards)

    return work.mapInArrow(run, LISTS)


# -- the model ------------------------------------------------------------------------
class Automaton:
    """The part of the model that a block's texts can reach.

    A state is a seen history, and 0 words are the root. Tokens have their n-grams' numbers, so the arc from a state of k
    words with the next token is the n-gram of k + 1 words that ends there, and a failure leads to the k - 1 words before it.
    """

    def __init__(self, block: Block, root: np.ndarray, counts: list[np.ndarray], strength: tuple):
        """root: log10 weights of its arcs by word; counts: of words and of each order's n-grams."""
        n = len(block.ids)
        self.top = len(block.grams)
        #: By token: the root arc's weight and whether it leads to a state; then for histories of 1, 2, ... words the arc's weight (NaN: no arc) and the failure's.
        self.weights = [root[block.ids], (counts[0] > 0)[block.ids]]
        p = 10 ** root
        for k, g in enumerate(block.grams, start=1):
            before, c, m = counts[k - 1][g.begin], counts[k], strength[k]
            p = np.where(before > 0, (c + m * p[g.rest]) / (before + m), p[g.rest])
            arc, fail = np.full(n, np.nan), np.zeros(n)
            arc[g.places + k] = np.where(c > 0, np.log10(p), np.nan)[g.of]
            fail[g.places + k] = np.log10(m / (before + m))[g.of]
            self.weights += [arc, fail]

    def score(self, start: int, end: int) -> float:
        """One traversal of the tokens from start to end."""
        total, state, top = 0.0, 0, self.top
        for row in zip(*(w[start:end].tolist() for w in self.weights), strict=True):
            while state:
                arc = row[2 * state]
                if arc == arc:
                    break
                total += row[2 * state + 1]
                state -= 1
            total += row[2 * state]
            if state < top and (state or row[1]):
                state += 1
        return total


def _score(work: DataFrame, total: int, distinct: int, order: int, strength: tuple) -> DataFrame:
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    below = log10(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            block = Block(b.column(1)[0].as_py(), order)
            counts, _ = block.resolved([c[0] for c in b.columns[2:]])
            root = np.log10(counts[0] + 1) - below
            model = Automaton(block, root, counts, strength)
            score = [model.score(s, s + n) for s, n in zip(block.starts.tolist(), block.sizes.tolist(), strict=True)]
            add = lambda x: np.add.reduceat(x, block.starts)
            yield pa.RecordBatch.from_arrays(
                [block.doc_id.combine_chunks(), pa.array(block.held), pa.array(block.sizes.astype(np.int64)), pa.array(add((counts[0][block.ids] > 0).astype(np.int64))), pa.array(add(root[block.ids])), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return work.mapInArrow(run, schema)


def score_texts(docs: DataFrame, order: int = ORDER, strength: tuple = STRENGTH) -> DataFrame:
    """Scores of all rows of docs (doc_id, held_out, text) under a model of those not held out.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    """
    spark = docs.sparkSession
    folder, tasks = scratch(spark, "lm-texts"), shuffle_partitions(spark)
    blocks = make_blocks(docs, folder)
    n_blocks, n_words, n_tokens = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    # A block is work for a task, however few bytes its row has.
    dealt = lambda t: t.repartition(max(tasks, -(-n_blocks // 8)), F.xxhash64("block"))

    shards = shards_for(n_words, tasks)
    known = [totals(_word_lists(dealt(blocks), shards), shards, numbered_words)]
    total, distinct = known[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    work, shards = blocks.select("block", "path"), shards_for(n_tokens, tasks)
    for n in range(1, order + 1):
        work = work.join(of_blocks(known[-1], f"totals_{n}"), "block", "left")
        if n < order:
            known.append(totals(_gram_lists(dealt(work), shards), shards, numbered_keys))
    scored = stored(_score(dealt(work), total, distinct, order, strength), "lm-scores")
    discard(blocks, *known)
    remove(spark, folder)
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint"))
