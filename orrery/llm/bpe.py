"""Byte-level BPE by monoid tree reduction (operator 3).

A text is cut in halves down to leaves. Leaves are encoded by themselves, and
neighbours are joined: a window around the cut grows until it begins and ends
where the text's pieces must begin and end whatever stands outside, is encoded
again, and replaces the tokens under it. Such a place is one between a letter
or digit and ASCII white space: no alternative of the pattern holds white space
after something else, so a piece ends there in every scan, and no look-ahead
reaches further. Decoding concatenates leaves' bytes up the same tree.

Defined results: null counts as empty and has no tokens; texts of any length are
processed whole; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.shared import slices

LEAF_CHARS = 256
LEAF_TOKENS = 256
WINDOW_CHARS = 64
ASCII_SPACE = frozenset(" \t\n\r")


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> Coder:
    return Coder(ranks_path, pattern)


class Coder:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        size = max(ranks.values()) + 1
        self.table = [b""] * size
        for token, rank in ranks.items():
            self.table[rank] = token
        self.lengths = np.array([len(x) for x in self.table], dtype=np.int64)
        self.decimal = [str(i) for i in range(size)]

    # -- encoding -----------------------------------------------------------
    def encode(self, text: str, leaf: int = LEAF_CHARS) -> list[int]:
        return self._tree(text, 0, len(text), leaf)

    def _tree(self, text: str, lo: int, hi: int, leaf: int) -> list[int]:
        if hi - lo <= leaf:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid, leaf), self._tree(text, mid, hi, leaf))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The tokens of text[lo:hi] from those of both halves."""
        begin, end = self._stable_before(text, lo, mid), self._stable_after(text, mid, hi)
        keep = self._tokens(left, len(text[begin:mid].encode()), from_end=True)
        skip = self._tokens(right, len(text[mid:end].encode()), from_end=False)
        return left[: len(left) - keep] + self.leaf(text[begin:end]) + right[skip:]

    @staticmethod
    def _stable_before(text: str, lo: int, mid: int) -> int:
        """The last stable place in (lo, mid), found in a window that doubles; lo if there is none."""
        width, checked = WINDOW_CHARS, mid
        while True:
            least = max(lo + 1, mid - width)
            for i in range(checked - 1, least - 1, -1):
                if text[i] in ASCII_SPACE and text[i - 1].isalnum():
                    return i
            if least == lo + 1:
                return lo
            width, checked = 2 * width, least

    @staticmethod
    def _stable_after(text: str, mid: int, hi: int) -> int:
        """The first stable place in (mid, hi); hi if there is none."""
        width, checked = WINDOW_CHARS, mid + 1
        while True:
            most = min(hi, mid + width)
            for i in range(checked, most):
                if text[i] in ASCII_SPACE and text[i - 1].isalnum():
                    return i
            if most == hi:
                return hi
            width, checked = 2 * width, most

    def _tokens(self, ids: list[int], n_bytes: int, from_end: bool) -> int:
        """How many tokens at one end of ids make up n_bytes."""
        n = total = 0
        lengths = self.lengths
        while total < n_bytes:
            total += int(lengths[ids[-1 - n] if from_end else ids[n]])
            n += 1
        assert total == n_bytes, "a stable place is always between tokens"
        return n

    # -- decoding -----------------------------------------------------------
    def decode(self, ids: list[int], leaf: int = LEAF_TOKENS) -> bytes:
        parts = [b"".join(map(self.table.__getitem__, ids[i:i + leaf])) for i in range(0, len(ids), leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[i:i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """(id, ids array<int>), one row for each row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for b in slices(batches):
            ids = [c.encode(x or "", leaf) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches):
            n, of_ids, of_text = [], [], []
            for x in b.column(1).to_pylist():
                ids = c.encode(x or "", leaf)
                n.append(len(ids))
                of_ids.append(sha(" ".join(map(c.decimal.__getitem__, ids)).encode()))
                of_text.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
