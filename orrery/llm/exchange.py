"""Adding up keyed counts over blocks of data, without a row for each key.

A block sends its distinct keys with their counts as packed sorted lists to
shards of the key space; a shard adds up equal keys and sends the totals back in
each list's order, and whether another block has the key too. What moves are a few bytes for a key of a block, a frequent
key is one entry of each block, and a task holds one shard's lists.

Defined results: blocks without keys send nothing and get nothing; counts are
from 0 on; a block number must be its own, and no block is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import slices, stored

#: Keys of one shard, summed over blocks.
SHARD_KEYS = 1 << 21


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack_counts(counts: np.ndarray) -> bytes:
    """Numbers from 0 on: a byte each, and those of 255 or more once more in full."""
    return squeezed(len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    data = unsqueezed(data)
    n = int.from_bytes(data[:8], "little")
    counts = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", -1, 8 + n)
    return counts


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the bytes of their differences, the lowest bytes first."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return squeezed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueezed(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def spans(keys: np.ndarray, shards: int) -> list[int]:
    """Where each shard's keys begin among ascending ones, and their number: a shard is what the highest bits say."""
    bits = shards.bit_length() - 1
    starts = np.array([s << (64 - bits) for s in range(shards)] if bits else [0], dtype=np.uint64)
    return [*np.searchsorted(keys, starts).tolist(), len(keys)]


def shards_for(keys: int, least: int) -> int:
    """A power of two, so that a shard gets about SHARD_KEYS and there is work for `least` tasks."""
    return 1 << max(0, max(-(-keys // SHARD_KEYS), least) - 1).bit_length()


LISTS = "shard bigint, block bigint, keys binary, counts binary"
TOTALS = "block bigint, shard bigint, counts binary, n bigint, v bigint"


def totals(lists: DataFrame, shards: int, numbered: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """For each list (shard, block, keys, counts) the sums over all blocks, in its order: twice the sum, plus one if other lists have the key.

    numbered: turns lists of keys into one number for each key, the same for equal ones, and the lists' lengths.
    n and v: the sum of a shard's counts, and the number of keys that have any; in a row without a block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in slices(batches, 64) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for shard, own in groupby(rows, key=lambda r: r[0]):
            _, blocks, keys, counts = zip(*own, strict=True)
            number, sizes = numbered(list(keys))
            total = np.bincount(number, weights=np.concatenate([unpack_counts(c) for c in counts])).astype(np.int64)
            said = 2 * total + (np.bincount(number) > 1)
            ends = np.cumsum(sizes)
            answers = [pack_counts(said[number[e - s:e]]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
            n = len(answers)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*blocks, None], pa.int64()), pa.array([shard] * (n + 1), pa.int64()), pa.array([*answers, None], pa.binary()),
                 pa.array([None] * n + [int(total.sum())], pa.int64()), pa.array([None] * n + [int((total > 0).sum())], pa.int64())],
                names=["block", "shard", "counts", "n", "v"])

    return stored(lists.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, TOTALS), "totals")


def packed_lists(block: int, keys: np.ndarray, counts: np.ndarray, shards: int, words: list[bytes] | None = None) -> pa.RecordBatch:
    """A block's rows of LISTS. keys: ascending; words: what is sent in their place."""
    cuts = spans(keys, shards)
    cut = [(s, lo, hi) for s, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
    own = [pack_keys(keys[lo:hi]) if words is None else squeezed(b" ".join(words[lo:hi])) for _, lo, hi in cut]
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, *_ in cut], pa.int64()), pa.array([block] * len(cut), pa.int64()), pa.array(own, pa.binary()), pa.array([pack_counts(counts[lo:hi]) for _, lo, hi in cut], pa.binary())],
        names=["shard", "block", "keys", "counts"])


def unpacked_totals(answers: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """A block's totals in the order of its keys, and which keys other blocks have too, from an array of (shard, counts)."""
    lists = [unpack_counts(x["counts"]) for x in sorted(answers.as_py() or (), key=lambda x: x["shard"])]
    said = np.concatenate([np.zeros(0, np.int64), *lists])
    return said >> 1, (said & 1).astype(bool)


def of_blocks(totals: DataFrame, name: str) -> DataFrame:
    """(block, name array<(shard, counts)>) of written totals."""
    return totals.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("shard", "counts")).alias(name))


def numbered_words(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = [unsqueezed(x).split(b" ") for x in lists]
    return pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy(), np.array([len(ws) for ws in words])


def numbered_keys(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack_keys(x) for x in lists]
    return np.unique(np.concatenate(keys), return_inverse=True)[1], np.array([len(k) for k in keys])
