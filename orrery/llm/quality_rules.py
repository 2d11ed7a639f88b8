"""Quality rules combined by weak supervision (operator 6).

Each rule votes good (2) or bad (0) or abstains (1) on a whole text. The rules
look at different things - symbols, ends of lines, lengths, variety, punctuation -
and several are noisy: they say bad of some texts that are fine. The votes of the
documents that pass the base rules are counted by pattern (at most
3 ** number of rules), and expectation-maximisation over these counts estimates
how often each rule votes each way on good and on bad texts, and the share of
good ones. No estimate is bounded; one imagined text of each class keeps it inside
(0, 1). A document's posterior probability of being good replaces the demand
that every rule be met: rules whose bad votes say little are outvoted.

Defined results: null or empty text has no words, fails the base rules and is
not kept, as does any text of under LEAST_WORDS words, on which all rules
abstain; texts of any length are judged whole; rows with a null id and repeated
rows are judged each; equal statistics give equal verdicts; a posterior of just
the threshold is kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import SPACE, discard, slices, stored

SYMBOLS = b"#*$%&|<>"
UPPER, LETTERS, DIGITS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(48, 58))
WINDOW = 8
BAD, ABSTAIN, GOOD = 0, 1, 2
INF = float("inf")
#: Within the first two bounds a rule votes good, outside the last two bad, else not at all.
RULES = (
    ("symbols", 0, 0.02, 0, 0.1),  # a word
    ("ended", 0.97, 1, 0.9, 1),  # lines that end in . ! or ?, of those with a word
    ("word_length", 4.4, 6.0, 0, 6.6),  # in characters, on average
    ("variety", 0.8, 1, 0.68, 1),  # different words among the first VARIETY
    ("commas", 0.035, INF, 0.02, INF),  # a word, with colons and semicolons
    ("stops", 0.05, 0.13, 0.035, 0.18),  # a word
    ("longest", 0, 20, 0, 28),  # word, in bytes
    ("digits", 0, 0.002, 0, 0.012),  # of the characters in words
    ("repeats", 0, 0.005, 0, 0.04),  # words in windows that come again
    ("words", 90, INF, 45, INF),  # in all
)
VARIETY = 100
#: Below this number of words a text is too short for ratios, and rules abstain.
LEAST_WORDS = 20
#: Where EM begins: the shares of good and bad texts, and the chances of a bad vote, an abstention and a good vote, of any rule on good texts and on bad ones.
SHARES, CHANCES, ROUNDS = (0.9, 0.1), ((0.02, 0.08, 0.9), (0.5, 0.2, 0.3)), 200


def without(text: bytes, chars: bytes) -> int:
    """How many bytes of text are one of chars."""
    return len(text) - len(text.translate(None, chars))


class Words:
    """The words of many texts as numbers: equal if and only if the words are."""

    def __init__(self, words: list[list[bytes]]):
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.texts = len(words)
        self.doc = np.repeat(np.arange(self.texts), self.sizes)
        self.ids = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)

    def _windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of a power of two of words begin, and a number for each: equal if the text and its words are."""
        ids, span = self.ids, 1
        if len(ids) < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        while span < size:
            ids = pd.factorize(ids[:-span] * (int(ids.max()) + 1) + ids[span:])[0].astype(np.int64)
            span *= 2
        inside = np.flatnonzero(self.doc[: len(ids)] == self.doc[size - 1:])
        if not len(inside):
            return inside, inside
        return inside, pd.factorize(self.doc[inside] * (int(ids.max()) + 1) + ids[inside])[0]

    def repeated(self, window: int = WINDOW) -> np.ndarray:
        """For each text, how many of its words lie in a window of words that is found twice or more in it."""
        at, key = self._windows(window)
        twice = at[np.bincount(key)[key] > 1] if len(at) else at
        edge = np.zeros(len(self.ids) + 1, dtype=np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + window, -1)
        return np.bincount(self.doc[np.cumsum(edge[:-1]) > 0], minlength=self.texts)


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    raw = [x.encode() for x in texts]
    split = [x.split() for x in raw]
    rows = []
    for text, b, w in zip(texts, raw, split, strict=True):
        lines = [x for x in b.split(b"\n") if x.strip(SPACE)]
        ended = sum(x.rstrip(SPACE)[-1:] in b".!?" for x in lines)
        first = w[:VARIETY]
        rows.append((len(w), len(text) - without(b, SPACE), without(b, SYMBOLS), len(lines) - len(set(lines)), len(lines), ended, len(first), len(set(first)), without(b, b",;:"), without(b, b"."), max(map(len, w), default=0), without(b, DIGITS)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_ended", "n_first", "n_different", "n_commas", "n_stops", "longest", "n_digits"]
    out = dict(zip(names, np.array(rows, dtype=np.int64).reshape(-1, len(names)).T, strict=True))
    return out | {"n_repeat_words": Words(split).repeated()}


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """One number for each text: its votes as digits of base 3, the first rule's lowest."""
    n, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    value = {
        "symbols": s["n_symbols"] / n, "ended": s["n_ended"] / np.maximum(s["n_lines"], 1), "word_length": s["word_chars"] / n, "variety": s["n_different"] / np.maximum(s["n_first"], 1),
        "commas": s["n_commas"] / n, "stops": s["n_stops"] / n, "longest": s["longest"], "digits": s["n_digits"] / chars, "repeats": s["n_repeat_words"] / n, "words": s["n_words"],
    }
    pattern = np.zeros(len(n), dtype=np.int64)
    for k, (name, good_from, good_to, bad_below, bad_above) in enumerate(RULES):
        v = value[name]
        vote = np.where((v >= good_from) & (v <= good_to), GOOD, np.where((v < bad_below) | (v > bad_above), BAD, ABSTAIN))
        pattern += 3 ** k * np.where(s["n_words"] < LEAST_WORDS, ABSTAIN, vote)
    return pattern


def beginning(rules: int = len(RULES)) -> tuple[np.ndarray, np.ndarray]:
    """The shares of the classes and chance[class, rule, vote] from which EM begins. Class 0 is good."""
    return np.array(SHARES), np.repeat(np.array(CHANCES)[:, None], rules, axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By expectation-maximisation over counted patterns (of number 0 they count for nothing): each pattern's posterior probability of good, the classes' shares, and

    chance[class, rule, vote]. Within a class votes count as independent, an abstention being a vote like others.
    """
    v = (patterns[:, None] // 3 ** np.arange(len(RULES))) % 3
    seen = np.stack([v == k for k in (BAD, ABSTAIN, GOOD)], axis=-1).astype(float)
    first_share, first = beginning()
    share, chance = first_share, first
    for _ in range(rounds):
        like = np.einsum("prv,crv->pc", seen, np.log(chance)) + np.log(share)
        like = np.exp(like - like.max(axis=1, keepdims=True))
        belongs = like / like.sum(axis=1, keepdims=True)
        weight = belongs * counts[:, None]
        share = (weight.sum(axis=0) + first_share) / (counts.sum() + 1)
        found = np.einsum("pc,prv->crv", weight, seen) + first  # one imagined text in each class
        chance = found / found.sum(axis=-1, keepdims=True)
    return belongs[:, 0], share, chance


STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def vote(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """A written table of the carried columns, the base statistics and the vote pattern, one row for each row of docs."""
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = statistics([x or "" for x in b.column(0).to_pylist()])
            arrays = [pa.array(s[k]) for k in names] + [pa.array(votes(s))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *arrays], names=[*carry, *names, "__pattern"])

    return stored(docs.select(F.col(text_col).alias("__text"), *carry).mapInArrow(run, ", ".join([*fields, STATS, "__pattern bigint"])), "votes")


def failed() -> Column:
    """The base rules' verdict, on a table of vote()."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def counted(voted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The patterns of a written table of votes, at most 3 ** len(RULES), and the numbers of documents with each that pass the base rules."""
    found = voted.groupBy("__pattern").agg(F.count_if(~failed()).alias("n")).orderBy("__pattern").toPandas()
    return found["__pattern"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=float)


def accuracies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(class, share, rule, bad, abstain, good): how often each rule votes each way in each class; class 0 is good, 1 bad."""
    voted = vote(docs, [], text_col)
    _, share, chance = estimate(*counted(voted))
    discard(voted)
    rows = [(c, float(share[c]), name, *map(float, chance[c, r])) for c in range(len(share)) for r, (name, *_) in enumerate(RULES)]
    return docs.sparkSession.createDataFrame(rows, "class int, share double, rule string, bad double, abstain double, good double")


def judge(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The carried columns, the base statistics, base_failed, posterior and kept, one row for each row of docs."""
    voted = vote(docs, ["doc_id"] if carry is None else carry, text_col)
    patterns, counts = counted(voted)
    good = estimate(patterns, counts)[0]
    table = docs.sparkSession.createDataFrame(list(zip(patterns.tolist(), good.tolist(), strict=True)), "__pattern bigint, posterior double")
    return (voted.join(F.broadcast(table), "__pattern", "left").drop("__pattern")
            .withColumn("base_failed", failed()).withColumn("kept", ~failed() & (F.col("posterior") >= threshold)))
