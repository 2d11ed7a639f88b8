"""Merges beside changes: what comes between freeze and swap, and merges that die."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import table, x  # noqa: F401  (fixtures)

from orrery.index import VectorIndex
from orrery.plans import build as B
from orrery.plans import search as S
from orrery.streaming.durable import DurableIndex

PARAMS = B.BuildParams(partitions=4, degree=16, length=40)


def changes(table, inserts="false", deletes="false", seq=1, moved=0.0):
    row = lambda op, keep: table.filter(keep).select(F.lit(op).alias("op"), F.col("vec_id").alias("tag"), F.transform("embedding", lambda v: (v + F.lit(moved)).cast("float")).alias("vec"), F.lit(seq).alias("seq"))
    return row("insert", inserts).unionByName(row("delete", deletes))


def check(index, table, x, live, moved=frozenset()):
    assert {r.tag for r in index.tags().collect()} == live
    ids = np.array(sorted(live))
    own = np.stack([x[i] + (50 if i in moved else 0) for i in ids]).astype(np.float64)
    queries = table.filter("vec_id % 40 = 5")
    got = {}
    for r in index.search(queries, S.SearchParams(k=5, length=80)).collect():
        got.setdefault(r.qid, []).append(r.id)
    hits = sum(len(set(found) & set(ids[np.argsort(((own - x[q]) ** 2).sum(axis=1), kind="stable")[:5]].tolist())) for q, found in got.items())
    assert len(got) == 10 and hits >= 0.95 * 50


def test_changes_between_freeze_and_swap(table, x, tmp_path, monkeypatch):
    index = DurableIndex.create(VectorIndex.build(table.filter("vec_id BETWEEN 1 AND 300"), PARAMS), f"file://{tmp_path}/index")
    live = set(range(1, 301))
    check(index, table, x, live)
    index.apply(changes(table, "vec_id BETWEEN 301 AND 350", "vec_id BETWEEN 1 AND 40"), 0)
    live = set(range(41, 351))
    check(index, table, x, live)  # seen before any merge
    frozen = index.freeze()
    # Meanwhile: a frozen insert is deleted, a frozen delete comes back elsewhere, and others change.
    index.apply(changes(table, "vec_id BETWEEN 36 AND 38 OR vec_id BETWEEN 360 AND 370", "vec_id BETWEEN 345 AND 350", moved=50.0), 1)
    live = live - set(range(345, 351)) | {36, 37, 38} | set(range(360, 371))
    moved = frozenset({36, 37, 38} | set(range(360, 371)))
    check(index, table, x, live, moved)
    before = index.version()[1]["upto"]
    index.merge(frozen)
    assert before == -1 and index.version()[1]["upto"] == 0
    assert {r.tag for r in index.version()[0].tags().collect()} == set(range(41, 351))  # the frozen changes alone
    check(index, table, x, live, moved)  # the later ones are replayed
    # A merge that dies before the swap changes nothing, and the next one does it all.
    note = VectorIndex.note
    monkeypatch.setattr(VectorIndex, "note", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        index.merge()
    monkeypatch.setattr(VectorIndex, "note", note)
    again = DurableIndex(table.sparkSession, f"file://{tmp_path}/index")
    assert again.version()[1]["upto"] == 0
    check(again, table, x, live, moved)
    again.merge()
    assert again.version()[1]["upto"] == 1 and again.journal(1).isEmpty()
    check(again, table, x, live, moved)
    assert again.merge().rows.count() == len(live)  # nothing new
    # Only partitions that the last merge touched lie in new folders.
    again.apply(changes(table, "vec_id = 399"), 2)
    old = again.version()[0].parted_graphs.folders
    new = again.merge().parted_graphs.folders
    assert len(set(map(tuple, new.values())) - set(map(tuple, old.values()))) == 1


def test_last_change_counts(table, x, tmp_path):
    index = DurableIndex.create(VectorIndex.build(table.filter("vec_id BETWEEN 1 AND 100"), PARAMS), f"file://{tmp_path}/index")
    index.apply(changes(table, "vec_id = 5", seq=1).unionByName(changes(table, "false", "vec_id = 5", seq=2)), 0)
    index.apply(changes(table, "vec_id = 6", "vec_id = 7"), 1)
    index.apply(changes(table, "vec_id = 7", "vec_id = 6"), 1)  # the batch again, otherwise
    assert {r.tag for r in index.tags().collect()} == set(range(1, 101)) - {5, 6}
    index.apply(changes(table, "false", "true"), 2)
    index.merge()
    assert index.tags().isEmpty()
    index.apply(changes(table, "vec_id BETWEEN 10 AND 60"), 3)
    index.merge()
    assert index.version()[0].rows.count() == 51
