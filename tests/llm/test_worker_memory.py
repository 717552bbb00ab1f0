"""What a Python worker holds while it cuts texts into tokens, and after a task."""

import tracemalloc

import numpy as np
import pyarrow as pa

from plumeflux import session
from plumeflux.llm import pieces
from plumeflux.llm.queries import vocabulary


def test_token_chunks_need_little_memory():
    words = np.random.default_rng(5).integers(0, 3000, 900_000)
    texts = pa.array([" ".join(f"word{w}" for w in part) for part in np.array_split(words, 300)])
    path = vocabulary("word_bpe_49k.json")
    pieces.encoder(path)
    tracemalloc.start()
    tokens = sum(int(np.diff(at)[inverse].sum()) for _, inverse, at, _, _ in pieces.token_chunks(texts, path, spaces=False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens >= len(words)
    assert peak < 70e6  # 24 bytes of work per byte of a chunk, powers and the pieces of a chunk


def test_task_releases_memory_after_its_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(session, "release_memory", lambda: seen.append("released"))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    for got in session.released(lambda batches: (seen.append("batch") or b for b in batches))(iter([batch, batch])):
        assert got.equals(batch)
    assert seen == ["batch", "batch", "released"]
    table = pa.table({"x": [1, 2]})
    assert session.released_group(lambda t: t.slice(1))(table).equals(table.slice(1))
    assert seen[3:] == ["released"]
