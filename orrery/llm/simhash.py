"""SimHash near-dedup by segment popcounts (operator 2).

A 64-bit fingerprint is cut into 32 segments of 2 bits and mapped to its vector
of segment popcounts. The Manhattan distance of two vectors never exceeds the
Hamming distance of the fingerprints, so fingerprints within 2 bits have vectors
within 2. The range-join runs on a grid whose 16 coordinates are sums of two
segments: a fingerprint enters its own cell and those one step away, and
fingerprints whose cells are within 2 steps meet in some cell, not by the same
step unless it is their own. In a cell the Manhattan distances of its vectors
are computed, and pairs within 2 are verified on the Hamming distance. Cells of
over BLOCK fingerprints are cut into blocks, which meet pairwise in tasks of
their own. What comes out of a block is not pairs, but each fingerprint with the
least one that it is linked to there, directly or over others. Components follow
by star steps.

near_duplicates() serves another notion: word shingles with a Jaccard similarity of
at least 0.8. So similar texts differ in up to 14 of 64 bits, where neither grid
nor any other lower bound leaves few candidates. The grid's links are taken as
probable edges; the others are found by a prefix-filter join, which misses
nothing: with all shingles in one order, rarest first, two sets of a similarity
of at least s have a shingle in common among the first n - ceil(s n) + 1 of each,
n being the set's size. Which of these shingles a node shares with any other is
found out by packed lists (exchange.py). Nodes that share one meet in blocks,
where pairs of different components are rejected by their sizes, by the shared
shingle's places, and by parity bitmaps: of the hashes' low bits one bit each says
whether an odd number of the set's shingles has them, so that the bits in which
two bitmaps differ are at most the shingles in which the sets do. What is left is
nearly always a link. A block sends not these pairs, but a forest of them: edges
that join components, fewer than it has nodes. All edges are verified on whole
texts. Where one is refuted, its component may hold pairs that no block sent, as
the edge seemed to join them; for the nodes of these components alone all pairs
that pass the bitmaps are verified in a second round.

Defined results: null or empty text, or one without words, has the fingerprint
zero and is linked like any other; texts of any length are taken whole; a null
id is never chosen over another, and of equal ids and texts none is told apart;
repeated rows get the same component; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.components import components
from orrery.llm.exchange import LISTS, numbered_keys, of_blocks, packed_lists, shards_for, totals, unpacked_totals
from orrery.llm.shared import LOWER, discard, encoded, of_keys, shuffle_partitions, slices, stored, tidied_shuffles

SEED = 42
#: SEGMENT_SUM segments make one coordinate of the grid.
SEGMENTS, SEGMENT_BITS, SEGMENT_SUM = 32, 2, 2
#: Fingerprints of at most so many different bits are linked.
NEAR = 2
#: Counters for the shingles' frequencies, the parts in which they are added up, and of how many tasks at a time.
COUNTERS, COUNTER_PARTS, ADDED = 1 << 20, 16, 64
#: The most bits of a parity bitmap; a set has twice the power of two from its size up.
BITMAP = 4096
#: Rows of one block where those that meet in a cell or by a shingle are compared block by block.
BLOCK = 512
#: Shingles of one packed list of nodes.
PACKED = 1 << 18
#: The byte lanes of a 64-bit word that count the bits of each byte value.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingles(text: bytes, k: int) -> list[bytes]:
    """Word shingles, repeats included; of fewer words the whole sequence."""
    w = text.translate(LOWER).split()
    if len(w) < k:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(k)), strict=False)]


def hashes(text: bytes, k: int) -> np.ndarray:
    """The shingles' XXH64, as big-endian 64-bit words."""
    h = xxhash.xxh64_digest
    return np.frombuffer(b"".join([h(x, SEED) for x in shingles(text, k)]), dtype=">u8")


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of h. As a signed 64-bit number."""
    n = len(h)
    if not n:
        return 0
    by_byte = LANES[h.view(np.uint8).reshape(-1, 8)]
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255):  # a lane counts to 255
        count += by_byte[at:at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * count > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint), one row for each row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = [fingerprint(hashes(x, shingle)) for x in encoded(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


# -- the grid ---------------------------------------------------------------------
POPCOUNTS = np.bitwise_count(np.arange(2**SEGMENT_BITS, dtype=np.uint8)).astype(np.int8)


def vectors(fps: np.ndarray) -> np.ndarray:
    """The segments' popcounts, lowest segment first: (n, SEGMENTS)."""
    cut = fps.astype(np.int64).view(np.uint64)[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(SEGMENT_BITS))
    return POPCOUNTS[(cut & np.uint64(2**SEGMENT_BITS - 1)).astype(np.int64)]


def grid(fps: DataFrame) -> DataFrame:
    """(cell, fp, step): each fingerprint in its own cell (step -1) and those one step up (2 i) or down (2 i + 1) in a coordinate i."""
    most = SEGMENT_BITS * SEGMENT_SUM
    weights = (most + 1) ** np.arange(SEGMENTS // SEGMENT_SUM, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            v = vectors(fp).reshape(len(fp), -1, SEGMENT_SUM).sum(axis=2, dtype=np.int64)
            own = v @ weights
            up, down = np.nonzero(v < most), np.nonzero(v > 0)
            rows = np.concatenate([np.arange(len(fp)), up[0], down[0]])
            cells = np.concatenate([own, own[up[0]] + weights[up[1]], own[down[0]] - weights[down[1]]])
            steps = np.concatenate([np.full(len(fp), -1), 2 * up[1], 2 * down[1] + 1])
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fp[rows]), pa.array(steps.astype(np.int32))], names=["cell", "fp", "step"])

    return fps.select("fp").mapInArrow(run, "cell bigint, fp bigint, step int")


def meeting_pairs(fp: np.ndarray, step: np.ndarray, block: np.ndarray, crossed: bool, near: int = NEAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of one cell, the pairs (i, j), i > j, whose vectors are within `near`, some rows at a time. crossed: only those of different blocks."""
    v = vectors(fp)
    for lo in range(1, len(fp), 256):
        i = np.arange(lo, min(lo + 256, len(fp)))
        j = np.arange(i[-1])
        ok = (j[None] < i[:, None]) & ((step[i][:, None] != step[j][None]) | (step[i][:, None] == -1))
        if crossed:
            ok &= block[i][:, None] != block[j][None]
        x, y = np.nonzero(ok)
        within = np.abs(v[i[x]] - v[j[y]]).sum(axis=1) <= near
        yield i[x[within]], j[y[within]]


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of 0 to n - 1 the least number that it is linked to by pairs (a, b), directly or over others."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def blocks_of(met: DataFrame, key: str, item: str, fields: list[str], block: int) -> DataFrame:
    """(key, lo, hi, all): rows that share a key, of which there are n, in blocks of about so many; each block meets each other and itself.

    all: array of (fields, own), own being a row's block. A key of one block is one row.
    """
    met = met.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return met.groupBy(key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list(F.struct(*fields, "own")).alias("all"))


def links(fps: DataFrame) -> DataFrame:
    """(u, v): fingerprints with the least one that they are linked to in a block of a cell, u > v.

    fps: distinct (fp). The links connect exactly what all pairs within 2 bits connect.
    """
    cells = stored(grid(fps), "cells")
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("least"), F.max("step").alias("most"))
    # Those that all came by one step have one cell of their own, where they meet.
    shared = stored(shared.filter("n > 1 AND (least <> most OR least = -1)").select("cell", "n"), "shared-cells")
    met = blocks_of(of_keys(cells, shared, "cell", cells.count()), "cell", "fp", ["fp", "step"], BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for row, crossed in enumerate((b.column(1).to_numpy() != b.column(2).to_numpy()).tolist()):
                fp, step, own = (x.to_numpy() for x in b.column(3)[row].values.flatten())
                order = np.argsort(fp, kind="stable")
                fp, step, own = fp[order], step[order], own[order]
                a, c = (np.concatenate(x) for x in zip(*meeting_pairs(fp, step, own, crossed), strict=True)) if len(fp) > 1 else out[0]
                close = np.bitwise_count((fp[a] ^ fp[c]).view(np.uint64)) <= NEAR
                least = least_linked(len(fp), a[close], c[close])
                linked = fp != fp[least]
                out.append((fp[linked], fp[least][linked]))
            u, v = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    out = stored(met.mapInArrow(run, "u bigint, v bigint").distinct(), "links")
    discard(cells, shared)
    return out


def near_components(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the least doc_id reachable over fingerprints within 2 bits."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    groups = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-groups")
    linked = links(groups.select("fp"))
    roots = components(linked)
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = stored(rooted.join(whole, "root").select("fp", "n", "component_id"), "fingerprint-components")
    discard(groups, linked)
    return of_keys(rows, of_fp, "fp", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- similarity of shingle sets ---------------------------------------------------
def bitmap(h: np.ndarray) -> bytes:
    """Of a set of distinct hashes, whether an odd number of them has given low bits, bit by bit."""
    bits = min(BITMAP, max(64, 2 << max(0, len(h) - 1).bit_length()))
    odd = np.bincount(((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of several lengths: the bits in which one differs from others, at the shorter's length."""

    def __init__(self, bitmaps: list[bytes]):
        self.words = np.array([len(b) // 8 for b in bitmaps])
        self.whole = [np.frombuffer(b, dtype=np.uint64) for b in bitmaps]
        self.folded: dict[int, np.ndarray] = {}

    def at(self, words: int) -> np.ndarray:
        """All bitmaps that are so long, folded to that length (others: zero)."""
        if words not in self.folded:
            out = np.zeros((len(self.whole), words), dtype=np.uint64)
            for i, b in enumerate(self.whole):
                if len(b) >= words:
                    out[i] = np.bitwise_xor.reduce(b.reshape(-1, words), axis=0)
            self.folded[words] = out
        return self.folded[words]

    def differ(self, i: int, others: np.ndarray) -> np.ndarray:
        out, words = np.empty(len(others), dtype=np.int64), np.minimum(self.words[others], self.words[i])
        for w in np.unique(words).tolist():
            own, these = self.at(w), words == w
            out[these] = np.bitwise_count(own[others[these]] ^ own[i]).sum(axis=1, dtype=np.int64)
        return out


def most_apart(size: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """In how many shingles similar sets of these sizes can differ."""
    return (size + other) * (1 - similarity) / (1 + similarity) + 1e-6


def _ranks(docs: DataFrame, shingle: int, text_col: str) -> np.ndarray:
    """By counter (the low bits of a shingle's hash) a byte that grows with the number of its shingles.

    It only makes the order of shingles cheap; any order gives the same links. Tasks' counts are added up ADDED at a time, in three levels.
    """
    each = COUNTERS // COUNTER_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.uint64)
        for b in slices(batches):
            h = [hashes(x, shingle) for x in encoded(b.column(0))]
            counts += np.bincount((np.concatenate(h).astype(np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint64)
        parts, task = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(COUNTER_PARTS, each)], TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task // ADDED] * COUNTER_PARTS, pa.int64()), pa.array(range(COUNTER_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["adder", "part", "counts"])

    def added(pdf: pd.DataFrame) -> np.ndarray:
        total = np.zeros(each, dtype=np.uint64)
        for x in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(x), dtype=np.uint64)
        return total

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"adder": pdf["adder"].iloc[:1] // ADDED, "part": pdf["part"].iloc[:1], "counts": [zlib.compress(added(pdf).tobytes(), 1)]})

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "ranks": [(4 * np.log2(added(pdf) + 1.0)).astype(np.uint8).tobytes()]})

    counts = docs.select(text_col).mapInArrow(run, "adder bigint, part int, counts binary")
    for _ in range(2):
        counts = counts.groupBy("adder", "part").applyInPandas(add, "adder bigint, part int, counts binary")
    ranks = np.zeros(COUNTERS, dtype=np.uint8)
    for r in counts.groupBy("part").applyInPandas(ranked, "part int, ranks binary").collect():
        ranks[r.part * each:(r.part + 1) * each] = np.frombuffer(r.ranks, dtype=np.uint8)
    return ranks


def prefix(h: np.ndarray, ranks: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the common order, one of which every similar set has among its own first, and the set's size.

    A set without shingles has the shingle 0, so that all such meet.
    """
    h = np.unique(h.astype(np.uint64))
    if not len(h):
        return np.zeros(1, dtype=np.int64), 0
    order = np.lexsort((h, ranks[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]))
    return h[order[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]].astype(np.int64), len(h)


#: A pack has at most 2 ** NODE_BITS nodes; a node's number is its pack's and its place in it.
NODE_BITS = 20
PACKS = "block bigint, digests array<binary>, ids array<{0}>, fps array<bigint>, bitmaps array<binary>, sizes array<int>, lengths array<int>, keys array<bigint>"


def _packs(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """A written table of the distinct texts (nodes), in packs of about PACKED prefix shingles."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(_ranks(docs, shingle, text_col))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = encoded(b.column(1))
            h = [hashes(x, shingle) for x in texts]
            first = [prefix(x, sent.value, similarity) for x in h]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([hashlib.sha256(x).digest() for x in texts]), pa.array([fingerprint(x) for x in h], pa.int64()), pa.array([bitmap(np.unique(x.astype(np.uint64))) for x in h], pa.binary()),
                 pa.array([x for x, _ in first], pa.list_(pa.int64())), pa.array([n for _, n in first], pa.int32())],
                names=["id", "digest", "fp", "bitmap", "prefix", "size"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def end() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            prefixes = rows.column("prefix").combine_chunks()
            lists = [rows.column(c).combine_chunks() for c in ("digest", "id", "fp", "bitmap", "size")] + [pa.array(np.diff(prefixes.offsets.to_numpy()), pa.int32()), prefixes.flatten()]
            own = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays([pa.array([(part << NODE_BITS) + number]), *own], names=["block", "digests", "ids", "fps", "bitmaps", "sizes", "lengths", "keys"])

        for b in slices(batches):
            held.append(b)
            n += len(b.column(2).flatten())
            if n >= PACKED or sum(x.num_rows for x in held) >= 1 << (NODE_BITS - 1):
                yield end()
                number, held, n = number + 1, [], 0
        if held:
            yield end()

    rows = docs.select(id_col, text_col).mapInArrow(sign, f"id {kind}, digest binary, fp bigint, bitmap binary, prefix array<bigint>, size int")
    nodes = rows.groupBy("digest").agg(F.min("id").alias("id"), F.first("prefix").alias("prefix"), *[F.first(c).alias(c) for c in ("fp", "bitmap", "size")])
    return stored(nodes.select("digest", "id", "prefix", "fp", "bitmap", "size").mapInArrow(pack, PACKS.format(kind)), "packs")


def _nodes(packs: DataFrame, *names: str) -> DataFrame:
    """(node, *names) of the packs; names: among digests, ids, fps, bitmaps, sizes, without the s."""
    zipped = F.arrays_zip(*[F.col(f"{n}s") for n in names])
    return packs.select("block", F.posexplode(zipped).alias("at", "x")).select(F.expr(f"shiftleft(block, {NODE_BITS}) + at").alias("node"), *[F.col(f"x.{n}s").alias(n) for n in names])


def _near(packs: DataFrame, similarity: float) -> DataFrame:
    """A written table of probable edges (a, b), a > b: nodes of one fingerprint with the least one that has it, and the grid's links

    between these, as far as bitmaps allow the similarity.
    """
    fps = _nodes(packs, "fp")
    first = stored(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("b")), "first-of-fingerprint")
    same = of_keys(fps, first.filter("n > 1"), "fp", fps.count()).select(F.col("node").alias("a"), "b").filter("a <> b")
    grid_links = links(first.select("fp"))
    least = lambda c, name: first.select(F.col("fp").alias(c), F.col("b").alias(name))
    far = grid_links.join(least("u", "x"), "u").join(least("v", "y"), "v").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    own = lambda name: _nodes(packs, "size", "bitmap").select(F.col("node").alias(name), F.struct("size", "bitmap").alias(f"of_{name}"))
    both = same.unionByName(far).distinct().join(own("a"), "a").join(own("b"), "b").select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep.append(Bitmaps([x["bitmap"], y["bitmap"]]).differ(0, np.array([1]))[0] <= most_apart(x["size"], y["size"], similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = stored(both.mapInArrow(run, "a bigint, b bigint"), "near")
    discard(first, grid_links)
    return out


SHARED = "key bigint, node bigint, root bigint, size int, at int, n bigint, bitmap binary"


def _shared_shingles(packs: DataFrame, roots: DataFrame) -> DataFrame:
    """A written table SHARED: the shingles of nodes' prefixes that n > 1 nodes have there. roots: (node, root) of those that have one."""
    tasks, (n_packs, n_keys) = shuffle_partitions(packs.sparkSession), packs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    shards = shards_for(n_keys, tasks)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            # A pack may have a shingle in several nodes; in one node it is once.
            keys, counts = np.unique(b.column(1).flatten().to_numpy().view(np.uint64), return_counts=True)
            yield packed_lists(b.column(0)[0].as_py(), keys, counts, shards)

    known = totals(packs.select("block", "keys").mapInArrow(lists, LISTS), shards, numbered_keys)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            bitmaps = b.column(1).flatten()
            size, length, key = (b.column(i).flatten().to_numpy() for i in (2, 3, 4))
            node = (b.column(0)[0].as_py() << NODE_BITS) + np.arange(len(size))
            root = node.copy()
            for r in b.column(6)[0].as_py() or ():
                root[r["node"] - node[0]] = r["root"]
            total = unpacked_totals(b.column(5)[0])[0][np.unique(key.view(np.uint64), return_inverse=True)[1]]
            at = np.arange(len(key)) - np.repeat(np.cumsum(length) - length, length)
            keep = total > 1
            row = np.repeat(np.arange(len(node)), length)[keep]
            for lo in range(0, len(row), SENT):
                i, k = row[lo:lo + SENT], np.flatnonzero(keep)[lo:lo + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[k], node[i], root[i], size[i], at[k].astype(np.int32), total[k])] + [bitmaps.take(pa.array(i))], names=["key", "node", "root", "size", "at", "n", "bitmap"])

    rooted = roots.filter("node <> root").groupBy(F.shiftright("node", NODE_BITS).alias("block")).agg(F.collect_list(F.struct("node", "root")).alias("roots"))
    work = packs.select("block", "bitmaps", "sizes", "lengths", "keys").repartition(max(tasks, n_packs), "block").join(of_blocks(known, "totals"), "block").join(rooted, "block", "left")
    out = stored(work.select("block", "bitmaps", "sizes", "lengths", "keys", "totals", "roots").mapInArrow(shared, SHARED), "shared-shingles")
    discard(known)
    return out


#: Rows of a batch that a task sends.
SENT = 1 << 14


def _probable(shared: DataFrame, similarity: float, every: bool) -> DataFrame:
    """A written table of probable edges (a, b), a > b, between nodes of different roots in rows of SHARED: from each block a forest, or all of them (every).

    Nodes that share a shingle are cut into blocks of about BLOCK, and each block meets each other and itself. Shingles all of whose nodes have one root are left out.
    """
    torn = shared.groupBy("key").agg(F.first("n").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key", "n")
    torn = stored(torn, "torn-shingles")
    met = blocks_of(of_keys(shared.drop("n"), torn, "key", shared.count()), "key", "node", ["node", "root", "size", "at", "bitmap"], BLOCK)

    def edges(node, root, size, at, bitmaps: Bitmaps, block, crossed: bool) -> Iterator[tuple[int, int]]:
        label = np.unique(root, return_inverse=True)[1]
        rest = size - at  # what can still be common, this shingle included
        for i in range(1, len(node)):
            least = similarity / (1 + similarity) * (size[i] + size[:i]) - 1e-6
            keep = (label[:i] != label[i]) & (np.minimum(rest[:i], rest[i]) >= least)
            if crossed:
                keep &= block[:i] != block[i]
            others = np.flatnonzero(keep)
            if not len(others):
                continue
            apart = bitmaps.differ(i, others)
            near = apart <= most_apart(size[i], size[others], similarity)
            for j in others[near][np.argsort(apart[near], kind="stable")].tolist():
                if every:
                    yield node[i], node[j]
                elif label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    yield node[i], node[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            for row, crossed in enumerate((b.column(1).to_numpy() != b.column(2).to_numpy()).tolist()):
                node, root, size, at, maps, block = b.column(3)[row].values.flatten()
                by = np.argsort(node.to_numpy(), kind="stable")  # so that blocks of the same nodes send the same edges
                node, root, size, at, block = (x.to_numpy()[by] for x in (node, root, size, at, block))
                found = list(edges(node, root, size, at, Bitmaps(maps.take(pa.array(by)).to_pylist()), block, crossed))
                if found:
                    u, v = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["a", "b"])

    out = stored(met.mapInArrow(run, "a bigint, b bigint").distinct(), "probable")
    discard(torn)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, stays, doc_id): one row for each distinct text, its digest (SHA-256), the least id that has it, and whether

    that document stays for its group: the group's least id.
    """
    with tidied_shuffles(docs.sparkSession):
        packs = _packs(docs, shingle, similarity, id_col, text_col)

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[bytes, np.ndarray] = {}

            def of(text: bytes) -> np.ndarray:
                if text not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[text] = np.unique(hashes(text, shingle).astype(np.uint64))
                return known[text]

            for b in slices(batches):
                holds = []
                for x, y in zip(encoded(b.column(2)), encoded(b.column(3)), strict=True):
                    x, y = of(x), of(y)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    holds.append(common >= similarity * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(holds, pa.bool_())], names=["u", "v", "holds"])

        def verified(pairs: DataFrame) -> DataFrame:
            """(u, v, holds) of edges (a, b), on the whole texts of the nodes in question, from one row each."""
            asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(_nodes(packs, "digest", "id"), "node")
            texts = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("__text")).withColumn("__digest", F.unhex(F.sha2(F.coalesce("__text", F.lit("")), 256)))
            texts = texts.join(asked, (F.col("__digest") == F.col("digest")) & F.col("__own").eqNullSafe(F.col("id")))
            of = stored(texts.select("node", "__text").dropDuplicates(["node"]), "texts")
            side = lambda name, text: of.select(F.col("node").alias(name), F.col("__text").alias(text))
            out = stored(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(verify, "u bigint, v bigint, holds boolean"), "verified")
            discard(of)
            return out

        near = _near(packs, similarity)
        as_edges = lambda t: t.select(F.col("a").alias("u"), F.col("b").alias("v"))
        shared = _shared_shingles(packs, components(as_edges(near)))
        edges = stored(near.union(_probable(shared, similarity, every=False)), "edges")
        checked = verified(edges)
        true = checked.filter("holds").select("u", "v")
        roots = components(true)
        if not checked.filter("NOT holds").isEmpty():
            # Components that only a refuted edge held together: all their pairs are looked at.
            seemed = components(as_edges(edges)).withColumnRenamed("root", "seemed").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            seemed = stored(seemed, "seemed")
            broken = seemed.groupBy("seemed").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("seemed")
            again = shared.drop("root").join(seemed.join(broken, "seemed", "left_semi").select("node", "root"), "node")
            more = _probable(stored(again, "shared-again"), similarity, every=True)
            more = verified(more.join(checked.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti"))
            # Roots stand for their nodes, so the steps begin from stars.
            roots = components(more.filter("holds").select("u", "v").union(roots.select("node", "root")))
        discard(near, edges, shared)
        rooted = _nodes(packs, "digest", "id").withColumnRenamed("id", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        chosen = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))).alias("first"))
        out = stored(rooted.join(chosen, "root").select("digest", (F.col("node") == F.col("first.node")).alias("stays"), "doc_id"), "near-duplicates")
        discard(packs)
        return out
