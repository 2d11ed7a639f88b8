"""Operators 11 to 13 on small fixtures: contracts by brute force, and the defined results of odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product
from math import floor, log

import duckdb
import numpy as np
import pytest

from orrery.llm import queries, repair, resampling, toxicity

DOCS = "doc_id bigint, text string, rank int, score int, vote string, __row int, conv_id int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "Two words", "ÉTÉ été 日本語 x9y", "a" * 60_000, "word " * 30_000]
    texts += [" ".join(rng.choice(["Alpha", "beta", "ÉTÉ", "x1", "the"]) + rng.choice(["", "q", "zz"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, t, 1, 2, "v", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[30], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def against_sql(spark, sf, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


# -- 11 --------------------------------------------------------------------------
def features(text, most=2):
    w = WORD.findall(lower(text or ""))
    return w, [" ".join(w[i:i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_resampling(spark, docs, most):
    target = ["the Alpha beta", None, "ÉTÉ x1 zz the the"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bucket = lambda g: zlib.crc32(g.encode()) % 97
    s = Counter(bucket(g) for _, t in rows for g in features(t, most)[1])
    t = Counter(bucket(g) for x in target for g in features(x, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: floor(1000 * log((t[b] + 1) * (all_s + 97) / ((s[b] + 1) * (all_t + 97)))) for b in s}
    want = []
    for i, x in rows:
        w, f = features(x, most)
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(w) >= 20])
    fit = sorted((r for r in want if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {}
    for n, r in enumerate(fit[: len(fit) * 25 // 100], start=1):
        rank.setdefault(tuple(r[:4]), []).append(n)
    got = resampling.resample(docs, bench, buckets=97, most=most).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted((tuple(r[:4]) for r in want), key=repr)
    found = {}
    for r in got:
        if r["rank"] is not None:
            found.setdefault(tuple(r)[:4], []).append(r["rank"])
    assert {k: sorted(v) for k, v in found.items()} == rank


def test_resampling_of_nothing(spark, docs):
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    got = resampling.resample(docs, none).collect()  # no target: gains from the source alone
    assert len(got) == docs.count() and all(r["rank"] is None or r["rank"] > 0 for r in got)


def test_resampling_against_sql(spark, sf):
    against_sql(spark, sf, "op11_resampling", ["documents", "benchmark"])


# -- 12 --------------------------------------------------------------------------
def cheapest(rows):
    """By all edits, over at most three turns: (cost, audit, repaired). rows: (role, text, fault)."""
    best = None
    inserts = [()] + [x for n in (1, 2) for x in product("ua", repeat=n)]
    full = {"u": "user", "a": "assistant"}
    options = []
    for role, text, fault in rows:
        own = [(2, "D", ())]
        if fault not in (1, 2):
            more = 5 * (fault == 3)
            own += [(more, "K", ((role, text),))] + [(1 + more, "R", ((full[c], text),)) for c in "ua"]
        options.append(own)
    for gaps in product(inserts, repeat=len(rows) + 1):
        for edits in product(*options):
            cost, audit, said = 0, "", []
            for i, g in enumerate(gaps):
                cost, audit, said = cost + 5 * len(g), audit + "I" * len(g), said + [(full[c], "") for c in g]
                if i < len(rows):
                    c, a, kept = edits[i]
                    cost, audit, said = cost + c, audit + a, said + list(kept)
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said)) and all(r for r, _ in said) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
    return best


def faults(rows):
    out = []
    for i, (role, text) in enumerate(rows):
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(1 if not end else 2 if (role, text) in rows[:i] else 3 if end[-1] not in ".!?" else 0)
    return out


def test_shortest_equals_all_edits():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "ui", ""]), rng.choice(["Yes.", "No", "", "Why?"])) for _ in range(rng.randrange(4))]
        kinds = faults(rows)
        cost, audit, said = cheapest([(*r, k) for r, k in zip(rows, kinds, strict=True)])
        found = repair.shortest([(r, k, 1) for (r, _), k in zip(rows, kinds, strict=True)])
        assert list(found.values()) == [(cost, audit)]
        assert repair.edited([(*r, 1) for r in rows], repair.START, audit) == said


def report_of(conv):
    """conv: [(turn, role, text)] in any order."""
    rows = sorted(conv, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    said = [r[1:] for r in rows]
    kinds = faults(said)
    cost, audit = next(iter(repair.shortest([(r, k, 1) for (r, _), k in zip(said, kinds, strict=True)]).values()))
    made = repair.edited([(*r, 1) for r in said], repair.START, audit)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in {"su", "ua", "au"} for a, b in zip(said, said[1:]))
    return (gaps, kinds.count(1), kinds.count(2), kinds.count(3), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


@pytest.mark.parametrize("block", [3, 512])
def test_repair(spark, block):
    rng, convs = random.Random(4), {}
    for c in [None, *range(12)]:
        convs[c] = [(rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool"]), rng.choice(["Yes.", "No", "", " \n", "Why?", "été !", "x" * 3000 + "."])) for _ in range(rng.choice([1, 2, 5, 9, 30]))]
    convs[3] = [(i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(40)] + [(5, "assistant", "turn 5.")] * 7
    rows = [(c, *r, "clash", 1) for c, own in convs.items() for r in own]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, audit string, block int").repartition(4)
    report, made = repair.repair(turns, block)
    sums = {r.conv_id: r.repaired_sha256 for r in repair.digests(made).collect()}
    got = {r.conv_id: (*tuple(r)[1:], sums[r.conv_id]) for r in report.collect()}
    assert got == {c: report_of(own) for c, own in convs.items()}
    assert {r.whole for r in made.select("whole").distinct().collect()} == ({True, False} if block == 512 else {False, True} if any(len(set(own)) <= 1 for own in convs.values()) else {False})


def test_blocks_carried_on_equal_one_search():
    rng = random.Random(6)
    for _ in range(100):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.randrange(4), rng.choice([1, 1, 1, 3])) for _ in range(rng.randrange(1, 14))]
        front, at = {repair.START: (0, "", None)}, 0
        while at < len(rows):
            n = rng.randrange(1, 5)
            front = repair.carried_on(front, {s: repair.shortest(rows[at:at + n], s, every=True) for s in repair.FITTING})
            at += n
        assert min(front[s][:2] for s in repair.ACCEPTING if s in front) == next(iter(repair.shortest(rows).values()))


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, None) for t in (*range(40), None) for r, x in (("assistant", "a.b!c?d"), (None, None))]
    got = repair.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_repair_of_little(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    none = spark.createDataFrame([], schema)
    assert repair.repair_report(none).count() == 0
    some = spark.createDataFrame([(4, 1, "user", "a."), (None, None, None, None)], schema)
    got = {r.conv_id: r for r in repair.repair_report(none, some).collect()}  # all rows lost
    assert set(got) == {4, None} and all(tuple(r)[1:7] == (0,) * 6 and r.audit == "" and r.repaired_sha256 == hashlib.sha256().hexdigest() for r in got.values())
    got = {r.conv_id: r for r in repair.repair_report(some).collect()}
    assert (got[4].cost, got[4].audit) == (2, "D") and (got[None].blank, got[None].audit, got[None].gaps) == (1, "D", 0)


def test_repair_against_sql(spark, sf):
    against_sql(spark, sf, "op12_repair", ["conversations"])


# -- 13 --------------------------------------------------------------------------
def test_nearest_equals_brute_force():
    rng = np.random.default_rng(3)
    size, entries = 40, {}
    for _ in range(700):
        t = sorted(rng.choice(size, rng.integers(1, 8), replace=False).tolist())
        w = rng.integers(1, 4, len(t)).astype(float)
        entries.setdefault(tuple(t), (t, w / np.linalg.norm(w), int(rng.integers(1, 5)), int(rng.integers(0, 2))))
    own = [entries[k] for k in sorted(entries)]
    index = toxicity.BlockMaxIndex(size, own, k=9, block=8)
    dense = np.zeros((len(own), size))
    for i, (t, w, *_) in enumerate(own):
        dense[i, t] = w
    opened = []
    for _ in range(200):
        t = sorted(rng.choice(size, rng.integers(1, 8), replace=False).tolist())
        w = rng.random(len(t)) + 0.1
        w /= np.linalg.norm(w)
        best, cosines, n = index.nearest(t, w)
        opened.append(n)
        query = np.zeros(size)
        query[t] = w
        exact = np.round(dense @ query, 10)
        order = np.lexsort((np.arange(len(own)), -exact))
        place = int(np.searchsorted(np.cumsum(index.examples[order]), 9))
        want = order[exact[order] >= exact[order][place]]
        assert np.allclose(cosines, exact[want]) and sorted(best.tolist()) == sorted(want.tolist())
        # The vote: k examples, those that tie at the last place share it.
        left, up, down = 9.0, 0.0, 0.0
        for c in sorted(set(exact[want].tolist()), reverse=True):
            tied = [i for i in want if exact[i] == c]
            n_tied = index.examples[tied].sum()
            share = min(1.0, left / n_tied)
            up += share * index.toxic[tied].sum() / (toxicity.NEAR + 1 - min(c, 1))
            down += share * n_tied / (toxicity.NEAR + 1 - min(c, 1))
            left -= share * n_tied
        assert index.vote(t, w)[0] == pytest.approx(up / down)
    assert np.mean(opened) < index.blocks  # bounds leave blocks out


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.predicted, known[i]) for i, r in got.items() if i in known and r.held_out]
    assert sum(p and not y for p, y in held) == 0  # clean texts are left alone
    taught = {i for i in known if not got[i].held_out}
    assert all(e.id in taught for r in got.values() for e in r.evidence)
    # Other columns, labels of held-out rows and the rows' order change nothing.
    changed = labels.selectExpr("doc_id", "1 - quality AS quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = toxicity.classify(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source", "'clash' AS evidence").repartition(5), changed)
    assert {r.doc_id: round(r.score, 9) for r in again.collect()} == {i: round(r.score, 9) for i, r in got.items()}


def test_toxicity_of_odd_inputs(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (3, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    same = {r.doc_id: r.score for r in rows}
    assert same[0] == same[1]  # null and empty
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    text_ids = docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text")
    assert toxicity.classify(text_ids, labels.selectExpr("CAST(doc_id AS STRING) AS doc_id", "toxic")).count() == docs.count()
