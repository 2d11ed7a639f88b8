"""Vector bin packing of examples into training sequences (operator 4).

Every piece has a demand on three limits: tokens, segments (one) and
loss-bearing tokens. A sequence takes, again and again, the waiting piece whose
demand has the largest dot product with what the sequence has left, both as
shares of the limits, among those that fit. When none fits and cutting is
allowed, the piece of which most fits is cut to fill the rest. Of equal ones the
first in the pool is taken. Longer examples wait as pieces that a sequence can
hold; none passes the pool by.

Each task packs its own rows and keeps at most POOL waiting pieces, so memory is
bounded and no row moves. A sequence that a limit or the end of the rows closes
early is cut back to a power of two, which needs no padding, if it lacks more
than 1 / SLACK of its tokens.

Defined results: a null or empty text has the end id alone; a text of any length
is cut into as many pieces as it needs; rows with a null id and repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import SPACE, slices

LENGTH = 2048
#: A sequence's limits besides its tokens: segments, and tokens that bear loss.
MAX_SEGMENTS, MAX_LOSS = 8, 2016
POOL = 512
#: Documents that are encoded at once, and where the ids leave with their pieces, so that a worker holds fewer of both.
AT_ONCE, WITH_IDS = 1024, 256
SLACK = 32
#: Words whose ids are kept for reuse in a task.
CACHE_WORDS = 400_000
#: What the last token of a piece ends with.
WORD_END = "</w>"
#: Kinds of bytes of a word: ASCII letters and the bytes of U+00C0 to U+023F, but for NOT_LETTERS (the signs of multiplication and
#: division, and the dotted capital I, whose lower case is two characters); marks that make one piece after letters; others.
OTHER, LETTER, MARK_BYTE, BREAK = 0, 1, 2, 3
NOT_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = LETTER
KINDS[list(b".,;:!?\"'()[]*#$%&")] = MARK_BYTE
KINDS[10] = BREAK
#: A word that stands alone between others while they are encoded together.
MARK = "~"
END_ID = 1


class Packer:
    """Places pieces (key, start, ids, loss, more) into sequences. Yields (sequence, offset, piece)."""

    def __init__(self, length: int = LENGTH, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, cut: bool = True, pool: int = POOL, powers: bool = True):
        self.limits = np.array([length, max_segments, max_loss], dtype=np.float64)
        self.length, self.max_segments, self.max_loss, self.cut, self.pool, self.powers = length, max_segments, max_loss, cut, pool, powers
        self.waiting: list[tuple] = []
        self.demand = np.zeros((3, pool + 1))
        self.free = np.zeros(pool + 1)  # tokens without loss at a piece's beginning
        self.sequence = 0

    @staticmethod
    def _split(piece: tuple, n: int) -> tuple[tuple, tuple]:
        key, start, ids, loss, more = piece
        return (key, start, ids[:n], loss[:n], more), (key, start + n, ids[n:], loss[n:], more)

    @staticmethod
    def _fitting(loss: np.ndarray, tokens: int, most: int) -> int:
        """How many of a piece's first tokens fit: at most so many, of which at most so many bear loss."""
        loss = loss[:tokens]
        if int(loss.sum()) <= most:
            return len(loss)
        return int(np.searchsorted(np.cumsum(loss), most, side="right"))

    def add(self, key, ids: np.ndarray, loss: np.ndarray, more=None) -> Iterator[tuple]:
        """One example; loss marks its loss-bearing tokens."""
        piece = (key, 0, ids, loss, more)
        if not self.cut and (len(ids) > self.length or loss.sum() > self.max_loss):
            raise ValueError(f"example {key!r} exceeds a sequence, and cutting is not allowed")
        while len(piece[2]):
            head, piece = self._split(piece, self._fitting(piece[3], self.length, self.max_loss))
            self._wait(head)
            if len(self.waiting) > self.pool:
                yield from self._fill()

    def _wait(self, piece: tuple) -> None:
        i, loss = len(self.waiting), piece[3]
        self.demand[:, i] = len(loss), 1, loss.sum()
        self.free[i] = loss.argmax() if self.demand[2, i] else len(loss)
        self.waiting.append(piece)

    def _take(self, i: int) -> tuple:
        piece, last = self.waiting[i], len(self.waiting) - 1
        self.waiting[i], self.demand[:, i], self.free[i] = self.waiting[last], self.demand[:, last], self.free[last]
        self.waiting.pop()
        return piece

    def _fill(self, target: int | None = None) -> Iterator[tuple]:
        """One sequence out of the waiting pieces, of at most target tokens."""
        target = target or self.length
        left, chosen, total = np.array([target, self.max_segments, self.max_loss], dtype=np.float64), [], 0
        while self.waiting and left[0] > 0 and left[1] > 0:
            d = self.demand[:, : len(self.waiting)]
            score = (left / self.limits ** 2) @ d
            fits = (d[0] <= left[0]) & (d[2] <= left[2])
            best = int((score * fits).argmax())
            if fits[best]:
                piece = self._take(best)
            elif self.cut:
                i = int(np.minimum(left[0], self.free[: len(self.waiting)] + left[2]).argmax())
                n = self._fitting(self.waiting[i][3], int(left[0]), int(left[2]))
                if n == 0:
                    break
                piece, rest = self._split(self._take(i), n)
                self._wait(rest)
            else:
                break
            left -= len(piece[2]), 1, int(piece[3].sum())
            chosen.append(piece)
            total += len(piece[2])
        if self.cut and self.powers and (self.length - total) * SLACK > self.length:
            over = total - (1 << (total.bit_length() - 1))
            while over:
                last = chosen.pop()
                if len(last[2]) > over:
                    piece, last = self._split(last, len(last[2]) - over)
                    chosen.append(piece)
                over -= len(last[2])
                self._wait(last)
        at = 0
        for piece in chosen:
            yield self.sequence, at, piece
            at += len(piece[2])
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            total = int(self.demand[0, : len(self.waiting)].sum())
            yield from self._fill(1 << (total.bit_length() - 1) if self.cut and self.powers and total < self.length else None)


def pieces(words: list[bytes]) -> np.ndarray:
    """How many pieces each word has for sure: one of Latin letters alone, two with a run of marks after them; 0 for any other word."""
    flat = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    kind = KINDS[flat]
    for lead, second in NOT_LETTERS:
        kind[np.flatnonzero((flat[:-1] == lead) & (flat[1:] == second))] = OTHER
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    bad = np.zeros(len(words), dtype=bool)
    bad[np.searchsorted(ends, np.flatnonzero(kind == OTHER))] = True
    bad[np.searchsorted(ends, np.flatnonzero((kind[:-1] == MARK_BYTE) & (kind[1:] == LETTER)))] = True
    bad |= kind[starts] != LETTER
    return np.where(bad, 0, 1 + (kind[ends - 1] == MARK_BYTE))


@lru_cache(maxsize=2)
def words_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class WordTokenizer:
    """The ids of texts under a tokenizers file that never joins text across ASCII white space.

    Distinct words are encoded once and kept; ids are those of the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.mark = array("I", self.own.encode(MARK, add_special_tokens=False).ids).tobytes()
        vocabulary = self.own.get_vocab()
        #: Whether an id ends a piece of a word; pieces are what the file's pattern cuts a word into.
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode_batch(self, texts: pa.Array, heads: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Each text's ids, and how many of them are its first words', of which heads has the numbers."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        flat = lists.flatten()
        held = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at a text's ends leaves empty ones
        bounds = np.concatenate([[0], np.cumsum(held)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        coded = flat.filter(pa.array(held)).dictionary_encode()
        data, at = coded.dictionary.buffers()[2].to_pybytes() if len(coded.dictionary) else b"", np.frombuffer(coded.dictionary.buffers()[1], np.int32, len(coded.dictionary) + 1).tolist()
        ids, sizes = self._ids([data[a:b] for a, b in zip(at, at[1:], strict=False)])
        word = coded.indices.to_numpy()
        begins, n = (np.cumsum(sizes) - sizes)[word], sizes[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        every = ids[np.repeat(begins - ends[:-1], n) + np.arange(ends[-1])]
        cuts, free = ends[bounds], ends[bounds[:-1] + heads] - ends[bounds[:-1]]
        return [(every[a:b], f) for a, b, f in zip(cuts.tolist(), cuts[1:].tolist(), free.tolist(), strict=False)]

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different words, one after the other, and each word's number of them."""
        if len(self.known) > CACHE_WORDS:  # words in use come back from the older half
            self.old, self.known = self.known, {}
        parts = list(map(self.known.get, words))
        lost = [i for i, part in enumerate(parts) if part is None]
        new = [words[i] for i in lost]
        if self.old:
            self.known.update((w, self.old[w]) for w in new if w in self.old)
            new = [w for w in new if w not in self.known]
        if new:
            n = pieces(new)
            plain, others = [new[i] for i in np.flatnonzero(n)], [new[i] for i in np.flatnonzero(n == 0)]
            n = n[n > 0]
            for at in range(0, len(plain), 64):
                self._learn_plain(plain[at:at + 64], n[at:at + 64])
            for at in range(0, len(others), 64):
                self._learn(others[at:at + 64])
        for i in lost:
            parts[i] = self.known[words[i]]
        return np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4

    def _learn_plain(self, words: list[bytes], n: np.ndarray) -> None:
        """Encode words of n pieces in one text, and cut its ids at the pieces' ends."""
        ids = np.array(self.own.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        ends, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(n)
        if len(ends) != last[-1] or ends[-1] != len(ids):
            return self._learn(words)
        cuts, data = [0, *(4 * ends[last - 1]).tolist()], ids.tobytes()
        self.known.update(zip(words, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def _learn(self, words: list[bytes]) -> None:
        """Encode words in one text, a mark after each; one by one where that can't be told apart."""
        after = f" {MARK} "
        together = array("I", self.own.encode_batch_fast([after.join(w.decode() for w in words)], add_special_tokens=False)[0].ids).tobytes()
        parts = together.split(self.mark) if MARK.encode() not in b"".join(words) else []
        if len(parts) != len(words) or any(len(x) % 4 for x in parts):
            parts = [array("I", e.ids).tobytes() for e in self.own.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        self.known.update(zip(words, parts, strict=True))


PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, loss_tokens bigint"


def first_line(text: Column) -> Column:
    """How many characters the first of several lines has, with its end; 0 for a text of one line."""
    return F.coalesce(F.instr(text, "\n"), F.lit(0))


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, prompt: Column | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: which ids of which document stand where, and how many of them bear loss.

    prompt: how many characters at the beginning of a text bear no loss, as far as whole
    words go; its first line, if more follow, by default.
    sequence_id: the task's number times 2^32, plus the sequence's number in it.
    with_ids adds the piece's ids.
    """
    schema = PACKED + (", ids array<int>" if with_ids else "")
    prompt = first_line(F.col("text")) if prompt is None else prompt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = words_tokenizer(tokenizer_path), Packer(length, max_segments, max_loss)
        first = TaskContext.get().partitionId() << 32

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = [[p[0] for _, _, p in rows], [p[1] for _, _, p in rows], [len(p[2]) for _, _, p in rows], [zlib.crc32(p[2].tobytes()) for _, _, p in rows],
                       [p[4] for _, _, p in rows], [first + s for s, _, _ in rows], [o for _, o, _ in rows], [int(p[3].sum()) for _, _, p in rows]]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            if with_ids:
                arrays.append(pa.array([p[2].astype(np.int32) for _, _, p in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in slices(batches, WITH_IDS if with_ids else AT_ONCE):
            rows: list[tuple] = []
            heads = [whole_words(x, n) if n else 0 for x, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            for key, (ids, free) in zip(b.column(0).to_pylist(), tokens.encode_batch(b.column(1), np.array(heads, dtype=np.int64)), strict=True):
                ids = np.append(ids, np.array([END_ID], dtype="<u4"))
                loss = np.ones(len(ids), dtype=np.int8)
                loss[:free] = 0
                rows += packer.add(key, ids, loss, len(ids))
            yield table(rows)
        yield table(list(packer.finish()))

    return docs.select("doc_id", "text", prompt.cast("bigint")).mapInArrow(run, schema)


def whole_words(text: str, chars: int) -> int:
    """How many words end within so many characters."""
    if not chars:
        return 0
    head = text[:chars].encode()
    inside = bool(head) and head[-1:] not in SPACE and chars < len(text) and text[chars] not in SPACE.decode()
    return len(head.split()) - inside
