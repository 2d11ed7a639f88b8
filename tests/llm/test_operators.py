"""The ten operators on small fixtures: contracts by brute force, and the defined results of odd inputs."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
import xxhash

from orrery.llm import bpe, chat, exact_dedup, exchange, language_model, line_dedup, packing, quality_classifier, quality_rules, simhash, warc
from orrery.llm.components import components
from orrery.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, digest string, n_lines int, fp string, pattern string, block int, kept string"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def odd_texts():
    rng = random.Random(4)
    base = " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "été", "日本", "x1", "the", "of"]) + str(rng.randrange(40)) for _ in range(300))
    texts = [None, "", " \n\t ", "one", "one two", "One  TWO", base, base, base + " end", base.upper(), base.replace("alpha", "alphb", 1), "\n".join(["same line"] * 40), "a" * 50_000, "word " * 30_000, "¿Qué? ¡No!\r\nÁÉ\x0b\x0cz", "x" * 999, "<s>[INST] a [/INST]</s>"]
    return texts + [f"Common Line\n  COMMON line \nown {i}\n" for i in range(12)]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, None, "s", 1, 0.5, "d", 3, "f", "p", 1, "k") for i, t in enumerate(odd_texts())]
    rows += [rows[6], (None, "one two", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# -- 1 ---------------------------------------------------------------------------
def test_warc(spark, tmp_path):
    big, small = "p" * 1000, "p" * 999
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "u\r\nv", small), (4, "u", small), (5, "u", None), (6, "u", ""), (None, "u", "é\r\n\r\nWARC/1.1\r\n" * 200), (7, "u", "x" * 3_000_000), (8, "u", "é" * 500), (10, "u", "é" * 500)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows + [(9, None, big)]], "page_id bigint, url string, html string, archive string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    got = warc.archive_pages(pages, folder).collect()
    assert len(got) == 12
    for r in got:
        full = [p or "" for i, _, p in rows if i == r.page_id][0].encode()
        assert r.payload_bytes == len(full) and r.payload_digest == hashlib.sha1(full).hexdigest()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or -1) for r in got)
    assert kinds == [(0, "response", -1), (1, "revisit", 9), (2, "revisit", 9), (3, "response", -1), (4, "response", -1), (5, "response", -1), (6, "response", -1), (7, "response", -1), (8, "revisit", 10), (9, "response", -1), (9, "revisit", 9), (10, "response", -1)]
    # Every member stands alone, and the sidecar index names its place.
    for index in (tmp_path / "warc/normal").glob("*.index"):
        data = index.with_name(index.name.removesuffix(".index")).read_bytes()
        for line in index.read_text().splitlines():
            offset, size, kind, _ = line.split(" ")
            one = zlib.decompress(data[int(offset):int(offset) + int(size)], 31)
            assert one.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and one.endswith(b"\r\n\r\n")
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_inflate_reads_any_mixture_of_members(tmp_path):
    import io

    whole = b"".join(warc.response(i, "u", bytes([65 + i]) * 5000, "d") for i in range(5))
    for data in (warc.member(whole), warc.member(whole[:7000]) + warc.member(whole[7000:]), b"".join(warc.member(whole[i:i + 1]) for i in range(0, 300)) + warc.member(whole[300:])):
        assert b"".join(warc.inflate(io.BytesIO(data))) == whole
        r = warc.Records()
        assert [len(p) for chunk in warc.inflate(io.BytesIO(data)) for _, p in r.feed(chunk)] == [5000] * 5


# -- 2 ---------------------------------------------------------------------------
def brute_fingerprint(text, k=3):
    w = WORD.findall(lower(text or ""))
    s = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, near=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= near:
                root[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_on_documents(spark, sf, docs):
    for d in (spark.read.parquet(f"{sf}/documents.parquet"), docs):
        own = d.select("doc_id", "text").collect()
        fps = [brute_fingerprint(r.text) for r in own]
        want = sorted(((r.doc_id, f"{f:016x}", c) for r, f, c in zip(own, fps, brute_components([r.doc_id for r in own], fps))), key=repr)
        assert rows_of(simhash.near_components(d), "doc_id", "fingerprint", "component_id") == want


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for f in list(fps):  # chains and stars around each
        for _ in range(6):
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    center = rng.getrandbits(64)  # a full cell: all that differ from one in two bits, and others of the same popcounts
    fps |= {center ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(8, 16)} | {center ^ (3 << 2 * i) ^ (3 << 2 * j) for i in range(32) for j in range(i)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = brute_components(signed, [x & (2**64 - 1) for x in signed])
    for block in (simhash.BLOCK, 7):
        own, simhash.BLOCK = simhash.BLOCK, block
        found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))).collect()
        simhash.BLOCK = own
        root = {r.node: r.root for r in found}
        assert [root.get(x, x) for x in signed] == want


def test_lower_bound_and_verification_both_reject(spark):
    fps = np.array([0b0000, 0b0011, 0b1100, 0b1111, 0b0101, 0b1010], dtype=np.int64) | 1 << 40
    v = simhash.vectors(fps)
    assert v.shape == (6, 32) and v[:, :2].tolist() == [[0, 0], [2, 0], [0, 2], [2, 2], [1, 1], [1, 1]]
    cells = {}
    for r in simhash.grid(spark.createDataFrame([(int(x),) for x in fps], "fp bigint")).collect():
        cells.setdefault(r.cell, []).append((fps.tolist().index(r.fp), r.step))
    met, near, same = set(), set(), lambda a, b: a == b and a != -1
    for rows in cells.values():
        met |= {(max(i, j), min(i, j)) for i, a in rows for j, b in rows if i != j and not same(a, b)}
        at, steps = (np.array(x) for x in zip(*rows))
        near |= {(max(at[i], at[j]), min(at[i], at[j])) for x, y in simhash.meeting_pairs(fps[at], steps, np.zeros(len(at)), False) for i, j in zip(x, y)}
    hamming = {(i, j): int(np.bitwise_count(np.uint64(fps[i] ^ fps[j]))) for i in range(6) for j in range(i)}
    manhattan = {(i, j): int(np.abs(v[i] - v[j]).sum()) for i in range(6) for j in range(i)}
    assert all(manhattan[p] <= hamming[p] for p in hamming)
    assert near == {p for p in hamming if manhattan[p] <= 2}
    assert (2, 1) in met - near  # one coordinate of the grid, and too far by Manhattan distance
    assert (5, 4) in near and manhattan[5, 4] == 0 and hamming[5, 4] == 4  # left to the verification


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (-3, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)} | {-3: -3, 2000: -3}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_simhash_empty(nothing):
    assert simhash.near_components(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


def test_bitmaps_are_a_lower_bound():
    rng = np.random.default_rng(8)
    for size in (0, 1, 60, 64, 65, 400, 3000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for other in (size, max(1, size // 3), size + 70):
            b = np.unique(np.concatenate([a[: other // 2], rng.integers(0, 2**63, other - other // 2, dtype=np.uint64)]))
            apart = len(np.setxor1d(a, b))
            maps = simhash.Bitmaps([simhash.bitmap(a), simhash.bitmap(b), simhash.bitmap(a)])
            assert maps.differ(0, np.array([1, 2])).tolist()[1] == 0
            assert maps.differ(0, np.array([1]))[0] == maps.differ(1, np.array([0]))[0] <= apart
            similar = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            assert similar == (apart <= simhash.most_apart(len(a), len(b), 0.8))


@pytest.mark.parametrize("kind", ["changed words", "stock sentences"])
def test_dense_families_send_few_pairs(spark, kind, monkeypatch):
    """What blocks send grows with the texts, not with their square."""
    rng, sent = random.Random(2), {}
    words = [f"w{i}" for i in range(3000)]
    stock = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(60)]
    base = [rng.choice(words) for _ in range(100)]

    def text():
        if kind == "stock sentences":
            return " ".join(rng.sample(stock, 8))
        c = list(base)
        for i in rng.sample(range(100), 2):
            c[i] = rng.choice(words)
        return " ".join(c)

    texts = [text() for _ in range(1000)]
    probable = simhash._probable
    for n in (500, 1000):
        made = []
        monkeypatch.setattr(simhash, "_probable", lambda *a, **b: made.append(probable(*a, **b)) or made[-1])
        monkeypatch.setattr(simhash, "discard", lambda *_: None)
        simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts[:n])), "doc_id bigint, text string")).count()
        sent[n] = sum(p.count() for p in made)
    # Of a thousand texts there are half a million pairs.
    assert sent == {500: 0, 1000: 0} if kind == "stock sentences" else sent[1000] <= 10 * 1000


def test_near_duplicates_by_similarity(spark, sf):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(n)] for n in (60, 200, 500, 900)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for share in (0.01, 0.015, 0.2):
            c = list(b)
            for i in rng.sample(range(len(c)), max(1, int(share * len(c)))):
                c[i] = rng.choice(words)
            texts.append(" ".join(c))
    texts += [texts[0], texts[0].upper(), "", None, " "]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {bytes(r.digest): r.stays for r in simhash.near_duplicates(own).collect()}

    def shingle_set(t):
        w = lower(t or "").split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = [shingle_set(t) for t in texts]
    linked = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if linked[i][j]) for i in range(len(texts))]
    for i, t in enumerate(texts):
        digest = hashlib.sha256((t or "").encode()).digest()
        first = next(j for j, u in enumerate(texts) if (u or "") == (t or ""))
        assert got[digest] == (root[first] == first), i


def test_near_duplicates_of_dense_families(spark):
    rng = random.Random(5)
    words, texts = [f"w{i}" for i in range(3000)], ["", " ", "\n", "w1 w2"]
    for size in (1500, 150, 150):  # in a family few pairs are linked, all others nearly
        base = [rng.choice(words) for _ in range(100)]
        for _ in range(size):
            c = list(base)
            for i in rng.sample(range(100), 2):
                c[i] = rng.choice(words)
            texts.append(" ".join(c))
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for block in (simhash.BLOCK, 20):
        own, simhash.BLOCK = simhash.BLOCK, block
        stay = sorted(r.doc_id for r in simhash.near_duplicates(docs).filter("stays").collect())
        simhash.BLOCK = own
        assert stay == sorted(set(root))


# -- 3 ---------------------------------------------------------------------------
def reference_encoding():
    import tiktoken

    with open(vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_tree_equals_the_library():
    own, c = reference_encoding(), bpe.Coder(vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "é", "1", "!", "\t", "\x1c", "　", "日", "́", "'", "don't", "\x85", "\r\n"]
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        ids = c.encode(s, rng.choice([1, 2, 5, 9]))
        assert ids == own.encode_ordinary(s) and c.decode(ids, 3) == s.encode()


def test_bpe_rows(docs, nothing):
    own = reference_encoding()
    args = (vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert rows_of(bpe.round_trip_digests(docs, *args, leaf=64), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.round_trip_digests(nothing, *args).count() == 0 and bpe.encode_column(docs, *args).count() == docs.count()


# -- 4 ---------------------------------------------------------------------------
def test_packing_places_each_id_once(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    hostile = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y ~ <|endoftext|>", "first line\nthen ~ more <|endoftext|>\n" * 400, "~ ~~ ~", "one\n" + "loss " * 5000]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(hostile)], "doc_id bigint, text string"))
    want = Counter(tuple([*own.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect())
    assert own.encode(hostile[0], add_special_tokens=False).ids == [320, 49407, 321]
    got = packing.pack_documents(docs, path, with_ids=True).collect()
    sequences, pieces = {}, {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss_tokens))
    for s in sequences.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048 and (2048 - at <= 64 or at & (at - 1) == 0)
        assert len(s) <= packing.MAX_SEGMENTS and sum(x for *_, x in s) <= packing.MAX_LOSS
    # Pieces of one document follow each other; documents with one id are told apart by their length.
    for r in sorted(got, key=lambda r: r.start):
        open_ = pieces.setdefault((r.doc_id, r.doc_tokens), [])
        next(p for p in [*open_, open_.append([]) or open_[-1]] if len(p) == r.start).extend(r.ids)
    assert Counter(tuple(p) for ps in pieces.values() for p in ps if p) == want
    # What bears no loss is the first of several lines.
    free = sum(len(own.encode((r.text or "").partition("\n")[0], add_special_tokens=False).ids) for r in docs.collect() if "\n" in (r.text or ""))
    assert sum(r.length - r.loss_tokens for r in got) == free > 0
    assert packing.pack_documents(nothing, path).count() == 0


def test_limits_bind_in_the_query(spark, sf):
    from pyspark.sql import functions as F

    got = packing.pack_documents(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), vocabulary_path("word_bpe_49k.json"))
    by = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("loss_tokens").alias("loss"), F.count(F.lit(1)).alias("segments")).toPandas()
    assert by.n.max() == 2048 and by.loss.max() == packing.MAX_LOSS and by.segments.max() == packing.MAX_SEGMENTS
    assert (by.loss == packing.MAX_LOSS).mean() > 0.1 and (by.segments == packing.MAX_SEGMENTS).sum() > 0
    short = by[(by.n < 2048) & (by.n & (by.n - 1) != 0)]
    assert (2048 - short.n).sum() < 0.001 * by.n.sum()  # padding


def test_words_equal_the_library():
    import pyarrow as pa

    rng = random.Random(6)
    alphabet = ["a", "B", "é", "İ", "ß", "ǅ", "ﬁ", "'s", "'t", "'", "!", "1", "日", "́", "ŉ", "o\u0308", "~", "<|endoftext|>", "x.", "…", "µ", "ª", "×", "÷", "ɐ", "ȿ"]
    texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 6))) for _ in range(40)) for _ in range(300)]
    texts += [None, "", "  lead x ", "\n", "\x0b\x0c a\x1cb\x85c\u2003d", "word word. word, (word) end"]
    own = packing.WordTokenizer(vocabulary_path("word_bpe_49k.json"))
    for _ in range(2):  # the second time from what is known
        for x, (ids, free) in zip(texts, own.encode_batch(pa.array(texts), np.zeros(len(texts), dtype=np.int64))):
            assert ids.tolist() == own.own.encode(x or "", add_special_tokens=False).ids and free == 0
    assert packing.pieces([b"abc", "é".encode(), b"end.", b"a.b", b"1", b"'s", "a×".encode(), "İx".encode(), b"x*!"]).tolist() == [1, 1, 2, 0, 0, 0, 0, 0, 2]
    assert own.encode_batch(pa.array([], pa.string()), np.zeros(0, dtype=np.int64)) == []


def test_whole_words():
    text = "ab cd\nef"
    assert [packing.whole_words(text, n) for n in range(len(text) + 1)] == [0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(2)
    for cut in (True, False):
        p, out = packing.Packer(64, max_segments=4, max_loss=30, cut=cut, pool=16, powers=False), []
        sizes = rng.integers(1, 29, 400)
        for i, n in enumerate(sizes):
            out += p.add(i, np.arange(n, dtype="<u4"), (np.arange(n) >= n // 3).astype(np.int8))
        out += p.finish()
        by = {}
        for s, o, piece in out:
            by.setdefault(s, []).append((o, piece))
        for pieces in by.values():
            assert len(pieces) <= 4 and sum(len(x[2]) for _, x in pieces) <= 64 and sum(int(x[3].sum()) for _, x in pieces) <= 30
        total = Counter()
        for _, _, piece in out:
            total[piece[0]] += len(piece[2])
        assert total == Counter(dict(enumerate(map(int, sizes))))
    with pytest.raises(ValueError):
        list(packing.Packer(8, cut=False).add(0, np.arange(9), np.ones(9)))


# -- 5 ---------------------------------------------------------------------------
def brute_lines(texts, least=10):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return [(len(ls), sum(n[key(x)] >= least for x in ls), "\n".join(x for x in ls if n[key(x)] < least)) for t in texts for ls in [(t or "").split("\n")]]


@pytest.mark.parametrize(("limit", "asked"), [(1 << 20, 500_000), (-1, 500_000), (-1, 7)])
def test_line_dedup(spark, docs, nothing, limit, asked, monkeypatch):
    monkeypatch.setattr(line_dedup, "ASKED_KEYS", asked)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    for name in ("row", "keys", "shard", "part"):  # columns of the input that the operator has names for too
        docs, nothing = docs.withColumnRenamed({"row": "lang", "keys": "source", "shard": "score", "part": "fp"}[name], name), nothing.withColumnRenamed({"row": "lang", "keys": "source", "shard": "score", "part": "fp"}[name], name)
    texts = [r.text for r in docs.select("text").collect()]
    index = line_dedup.LineIndex(spark).insert(docs)
    assert index.shards > 1
    got = index.clean(docs, filter_bytes=limit)
    assert rows_of(got, "n_lines", "n_dropped", "text") == sorted(brute_lines(texts), key=repr)
    assert set(got.columns) == set(docs.columns) | {"n_lines", "n_dropped"} and {r.source for r in got.withColumnRenamed("keys", "source").collect()} == {"s", None}
    assert line_dedup.LineIndex(spark).insert(nothing).clean(nothing, filter_bytes=limit).count() == 0


def test_deleting_what_was_not_inserted_is_an_error(spark, docs):
    with pytest.raises(Exception, match="never inserted"):
        line_dedup.LineIndex(spark).insert(docs).delete(spark.createDataFrame([("a line of nobody",)], "text string"))


def test_lines_that_were_not_inserted_stay(spark, docs, monkeypatch):
    """A filter may claim a line that it never saw; asked exactly, none is dropped."""
    index = line_dedup.LineIndex(spark).insert(docs)
    strange = spark.createDataFrame([("\n".join(f"line {i} of nobody" for i in range(j, j + 2000)),) for j in range(0, 40_000, 2000)], "text string")
    both = strange.union(docs.filter("text LIKE 'Common Line%'").select("text"))
    got = index.clean(both, inserted=False).collect()
    assert sum(r.n_dropped for r in got) == 2 * 12 and sum(r.n_lines for r in got) == 40_000 + 12 * 4


def test_line_dedup_is_reversible(spark, docs):
    more = docs.limit(20).select("text")
    one = line_dedup.LineIndex(spark).insert(docs)
    back = one.insert(more).delete(more)
    same = lambda a, b: rows_of(a, *a.columns) == rows_of(b, *b.columns)
    assert same(one.counts, back.counts) and same(one.frequent(), back.frequent())
    assert same(back.clean(docs).select("doc_id", "text"), one.clean(docs).select("doc_id", "text"))
    assert back.delete(docs).counts.count() == 0


def test_cuckoo_filter_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (4000, 2), dtype=np.uint64)
    f = line_dedup.CuckooFilter(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    f.delete(keys[:2000])
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys[2000:]).all() and f.contains(keys[:2000]).mean() < 0.01


# -- 6 ---------------------------------------------------------------------------
def test_rule_statistics(docs, nothing):
    want = []
    for r in docs.select("doc_id", "text").collect():
        t = r.text or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        held = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(held), len(w) < 20 or 100 * len(held) > 30 * len(w)))
    got = quality_rules.judge(docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not got.filter("kept AND base_failed").count() and quality_rules.judge(nothing).count() == 0


def brute_estimate(votes, counted, rounds):
    """The same expectation-maximisation, a text at a time. counted: the texts that it learns from."""
    share, chance = quality_rules.beginning()
    first_share, first = share.copy(), chance.copy()
    for _ in range(rounds):
        belongs = []
        for v in votes:
            like = [share[c] * np.prod([chance[c, r, k] for r, k in enumerate(v)]) for c in range(len(share))]
            belongs.append(np.array(like) / sum(like))
        share = (sum(b for b, own in zip(belongs, counted) if own) + first_share) / (sum(counted) + 1)
        chance = first.copy()
        for w, v, own in zip(belongs, votes, counted):
            for r, k in enumerate(v):
                chance[:, r, k] += w * own
        chance /= chance.sum(axis=2, keepdims=True)
    return np.array(belongs)[:, 0], share, chance


def test_estimate_equals_plain_em():
    rng = np.random.default_rng(4)
    n = len(quality_rules.RULES)
    votes = np.where(rng.random((120, n)) < 0.85, 2, rng.integers(0, 2, (120, n)))
    votes[:15, :3] = 0
    counted = rng.random(120) < 0.8
    patterns, inverse = np.unique(votes @ 3 ** np.arange(n), return_inverse=True)
    good, share, chance = quality_rules.estimate(patterns, np.bincount(inverse, counted, len(patterns)), rounds=25)
    want = brute_estimate(votes, counted, 25)
    assert np.allclose(good[inverse], want[0]) and np.allclose(share, want[1]) and np.allclose(chance, want[2])


def test_verdicts_equal_plain_em(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    own = d.select("doc_id", "text").collect()
    s = quality_rules.statistics([r.text or "" for r in own])
    votes = (quality_rules.votes(s)[:, None] // 3 ** np.arange(len(quality_rules.RULES))) % 3
    failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    good = brute_estimate(votes, ~failed, quality_rules.ROUNDS)[0]
    got = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert len(got) == len(own)
    for r, g, f in zip(own, good, failed):
        assert got[r.doc_id].posterior == pytest.approx(g, abs=1e-9) and got[r.doc_id].kept == (not f and g >= 0.5)


def test_rules_outvote_each_other(spark, sf):
    big = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    own = big.select("doc_id", "text").toPandas()
    stats = [quality_rules.statistics([x or "" for x in own.text[i:i + 500]]) for i in range(0, len(own), 500)]
    n = len(quality_rules.RULES)
    bad = (np.concatenate([quality_rules.votes(s) for s in stats])[:, None] // 3 ** np.arange(n)) % 3 == 0
    failed = np.concatenate([(s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"]) for s in stats])
    kept = own.doc_id.isin([r.doc_id for r in quality_rules.judge(big).filter("kept").collect()]).to_numpy()
    # At least six rules are outvoted on ten texts or more, and no two say the same.
    assert sum((bad & kept[:, None]).sum(axis=0) >= 10) >= 6
    assert (np.corrcoef(bad[~failed].T.astype(float)) - np.eye(n)).max() < 0.9
    of = quality_rules.accuracies(big).toPandas()
    assert set(of["class"]) == {0, 1} and np.allclose(of.bad + of.abstain + of.good, 1)
    repeats = of[(of.rule == "repeats") & (of["class"] == 0)].iloc[0]
    assert 0.001 < repeats.bad < 0.1  # an estimate, not a bound


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_rules_agree_with_labels(spark, sf, size):
    big = sf.replace("0.001", size)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = quality_rules.judge(spark.read.parquet(f"{big}/documents.parquet")).filter("NOT base_failed").join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.998 and got[got.quality == 0].kept.mean() < 0.01


# -- 7 ---------------------------------------------------------------------------
@pytest.mark.parametrize(("order", "block"), [(3, 1 << 20), (3, 20_000), (2, 20_000), (4, 300)])
def test_language_model(spark, sf, docs, nothing, order, block, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(language_model, "BLOCK_TOKENS", block)
    strength = (0.0, 50.0, 5.0, 2.0)
    real = spark.read.parquet(f"{sf}/documents.parquet")
    for d in (real, docs) if block > 300 else (docs,):
        d = d.select("doc_id", "text").withColumn("held_out", language_model.held_out(F.col("doc_id")))
        own = d.collect()
        tokens = [[*WORD.findall(lower(r.text or "")), ""] for r in own]
        held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in own]
        c = Counter(tuple(t[i:i + n]) for t, h in zip(tokens, held) if not h for n in range(1, order + 1) for i in range(len(t) - n + 1))
        n, v = sum(k for g, k in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

        def p(g):
            """Of a last word after the others."""
            if len(g) == 1:
                return (c[g] + 1) / (n + v + 1)
            m, before = strength[len(g) - 1], c[g[:-1]]
            return (c[g] + m * p(g[1:])) / (before + m) if before else p(g[1:])

        want = [(r.doc_id, h, len(t), sum(c[w,] > 0 for w in t), n, sum(log10(p((w,))) for w in t), sum(log10(p(tuple(t[max(0, i - order + 1):i + 1]))) for i in range(len(t)))) for r, t, h in zip(own, tokens, held)]
        got = rows_of(language_model.score_texts(d, order, strength), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        for a, b in zip(got, sorted(want, key=repr), strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
        if d.count() > 100:
            assert sum(x[6] for x in got if x[1]) > sum(x[5] for x in got if x[1])  # better than the base on held-out texts
        # The chances of all words and the unknown one add up to one after any history.
        unknown = (1 / (n + v + 1),)
        for h in list(c)[:3] + [g for g in c if len(g) == order - 1 and "" not in g][:3]:
            if "" not in h and len(h) < order:
                assert sum(p((*h, *g)) for g in c if len(g) == 1) + p((*h, *unknown)) == pytest.approx(1)
    assert language_model.score_texts(nothing.selectExpr("doc_id", "text", "false AS held_out")).count() == 0


def test_longer_histories_predict_better(spark, sf):
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").withColumn("held_out", language_model.held_out(F.col("doc_id")))
    two, three = (language_model.score_texts(d, n).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first() for n in (2, 3))
    assert three[0] > two[0] > two[1]


def test_packed_lists():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    assert np.array_equal(exchange.unpack_keys(exchange.pack_keys(keys)), keys)
    for counts in (np.zeros(0, np.int64), rng.integers(0, 600, 5000), np.array([254, 255, 256, 2**40])):
        assert np.array_equal(exchange.unpack_counts(exchange.pack_counts(counts)), counts)
    for shards in (1, 2, 64):
        cuts = exchange.spans(keys, shards)
        assert cuts[0] == 0 and cuts[-1] == len(keys) and len(cuts) == shards + 1
        assert all((keys[lo:hi] >> np.uint64(64 - shards.bit_length() + 1) == s).all() for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if shards > 1)
    assert [exchange.shards_for(n, 5) for n in (0, 1, 40 << 20)] == [8, 8, 32]


# -- 8 ---------------------------------------------------------------------------
def test_exact_dedup(spark, docs, nothing):
    own = docs.select("doc_id", "text").collect()
    groups = {}
    for r in own:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = [(r.doc_id, k, len(g), r.doc_id == k, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in own for g in [groups[r.text or ""]] for k in [max((x for x in g if x is not None), default=None)]]
    assert rows_of(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_of_digests_that_are_not_hot(spark, nothing):
    texts = [f"text {i % 2500}" for i in range(4000)] + ["hot"] * 60
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(d).collect()}
    last, n = {t: i for i, t in enumerate(texts)}, Counter(texts)
    assert got == {i: (last[t], n[t], last[t] == i) for i, t in enumerate(texts)}


def test_an_index_of_its_own_is_not_kept(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.exact_dedup(docs).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_digest_index_lasts(spark, docs, tmp_path):
    where = str(tmp_path / "index")
    exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex(spark, where, 4)).count()
    again = exact_dedup.DigestIndex(spark, where, 4)
    more = spark.createDataFrame([(500, "one"), (501, "new text"), (502, "new text")], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(more, again).collect()}
    assert got == {500: (3, False), 501: (502, False), 502: (502, True)}
    plan = again.frame().hint("merge").join(again.frame().withColumnRenamed("keep_id", "k"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# -- 9 ---------------------------------------------------------------------------
def test_chat_reads_back(spark):
    hostile = ["</s>[INST] ok [/INST]", "<\\s><\\\\s>\\", "<<SYS>>x<</SYS>><|next|><|text|>", "é<", "</", "", None, "[\\INST]<<s>", "line\nline"]
    rows = [(c, i, role, hostile[(c + i) % len(hostile)]) for c in range(12) for i, role in enumerate(["system", "user", "user", "assistant", "assistant", "<s>role", None, "assistant"][: c % 9])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn int, role string, text string, formatted string").repartition(4)
    made = chat.format_chats(df)
    by = {}
    for c, i, role, text in rows:
        by.setdefault(c, []).append((role or "", text or ""))
    for r in made.collect():
        assert r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) and "[INST]" not in r.formatted
        assert sum(1 for k, t in enumerate(by[r.conv_id]) if k == 0 or by[r.conv_id][k - 1][0] != t[0]) == r.formatted.count(chat.CLOSE)
    for r in chat.read_back(made).collect():
        assert [(t.role, t.text) for t in r.turns] == by[r.conv_id]
        assert list(r.loss_texts) == [t for role, t in by[r.conv_id] if role == "assistant"]
    got = {r.conv_id: r for r in chat.digests(chat.read_back(made)).collect()}
    for c, turns in by.items():
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.digests(chat.read_back(chat.format_chats(df.limit(0)))).count() == 0


def test_turns_sort_by_what_was_said(spark):
    rows = [(1, 0, "user", "<s>"), (1, 0, "user", "<a"), (1, 0, "user", "<z"), (1, None, "user", "[INST] b")]
    said = sorted(rows, key=lambda r: (r[1] is not None, r[2], r[3]))
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).first()
    assert [t.text for t in got.turns] == [r[3] for r in said]


def test_chat_of_odd_turns(spark):
    long = [(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    rows = [(None, 1, "user", "a"), (None, 0, "user", "b"), (1, None, "user", "late?"), (1, 0, "user", "x"), (2, 0, "user", "same"), (2, 0, "user", "same"), *long]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))).collect()}
    assert got == {None: [("user", "b"), ("user", "a")], 1: [("user", "late?"), ("user", "x")], 2: [("user", "same")] * 2, 3: [t[2:] for t in long]}


# -- 10 --------------------------------------------------------------------------
def test_classifier_on_held_out_labels(spark, sf):
    big = sf.replace("0.001", "0.01")
    documents, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = quality_classifier.classify(documents, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.predicted == got.quality).mean() > 0.95
    # Labels of held-out documents are never seen: turned round, they change nothing.
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    again = quality_classifier.classify(documents, turned)
    assert rows_of(again, "doc_id", "score") == rows_of(quality_classifier.classify(documents, labels), "doc_id", "score")


def test_classifier_equals_plain_numpy(spark, sf):
    big = sf.replace("0.001", "0.01")
    documents, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    y = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in texts}
    held = {r.doc_id for r in documents.selectExpr("doc_id", "pmod(xxhash64(doc_id), 4) = 0 AS c").filter("c").collect()}
    x = {i: np.array(quality_classifier.statistics(t)) for i, t in texts.items()}
    taught = np.array([x[i] for i in y])
    model = quality_classifier.Model(taught.mean(axis=0), np.maximum(taught.std(axis=0), 1e-9))
    rng = np.random.default_rng(quality_classifier.SEED)
    w, b = rng.normal(size=(x[0].size, 256)) / np.sqrt(x[0].size), rng.uniform(0, 2 * np.pi, 256)

    def features(rows):
        z = np.clip((rows - model.mean) / model.scale, -8, 8)
        return np.array([[*(np.cos(r @ w[:, j] + b[j]) * np.sqrt(2 / 256) for j in range(256)), 1.0] for r in z])

    fit = [i for i in y if i not in held]
    f, target = features(np.array([x[i] for i in fit])), np.array([y[i] for i in fit])
    penalty = np.diag([quality_classifier.RIDGE * len(fit) / 257 * 257 / 256] * 256 + [1e-9 / 256])
    beta = np.linalg.solve(f.T @ f + penalty, f.T @ target)
    calibrate = [i for i in y if i in held]
    knots = quality_classifier.isotonic(features(np.array([x[i] for i in calibrate])) @ beta, np.array([y[i] for i in calibrate]))
    ids = sorted(texts)
    want = dict(zip(ids, np.interp(features(np.array([x[i] for i in ids])) @ beta, *knots)))
    got = {r.doc_id: r.score for r in quality_classifier.classify(documents, labels).collect()}
    assert np.mean([abs(got[i] - want[i]) < 1e-3 for i in ids]) > 0.99  # a pool of the isotonic fit can hang on the last bits


def test_classifier_on_odd_inputs(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.classify(docs, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.classify(docs, some).count() == docs.count() and quality_classifier.classify(nothing, some).count() == 0


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    x, y = quality_classifier.isotonic(s, (s + rng.normal(size=500) > 0).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 <= y[0] and y[-1] <= 1
