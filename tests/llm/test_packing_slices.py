"""Packing holds the ids of few documents at once, and what it packs doesn't depend on how many."""

import numpy as np
import pyarrow as pa

from orrery.llm import packing as P
from orrery.llm.queries import vocabulary_path


class Rows:
    """Stands in for a DataFrame: gives back the function that tasks run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_few_documents_with_ids_are_held_at_once(spark, monkeypatch):
    rng, held = np.random.default_rng(3), []
    words = [f"w{i}" for i in range(300)]
    texts = ["\n".join(" ".join(rng.choice(words, 12)) for _ in range(int(n))) for n in rng.integers(0, 40, 700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700), pa.int64()), pa.array(texts), pa.array([x.find("\n") + 1 for x in texts], pa.int64())], names=["doc_id", "text", "prompt"])
    real = P.slices
    monkeypatch.setattr(P.TaskContext, "get", staticmethod(lambda: type("Context", (), {"partitionId": lambda self: 0})()))

    def watched(batches, rows):
        for b in real(batches, rows):
            held.append(b.num_rows)
            yield b

    monkeypatch.setattr(P, "slices", watched)
    run = P.pack_documents(Rows(), vocabulary_path("word_bpe_49k.json"), with_ids=True)
    packed = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    assert max(held) <= 256 and sum(held) == 700
    monkeypatch.setattr(P, "WITH_IDS", 1024)
    assert pa.Table.from_batches(list(run(iter([batch])))).to_pylist() == packed
