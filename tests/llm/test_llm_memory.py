"""What the Python side of a task holds while it works on a full batch, and what a worker keeps."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa

from corpuscope.llm import language, tokens


def test_language_of_a_full_batch():
    """Ten thousand rows, as Spark sends them at once, have a vector each, but not all at a time."""
    docs = MagicMock()
    docs.sparkSession.sparkContext.broadcast = lambda x: SimpleNamespace(value=x)
    vector, _ = language.bundled(["the whale in the sea"], np.zeros(1, np.int64), 1, language.TripleVectors())
    language.predict(docs, {"en": vector[0] / np.sqrt(vector[0] @ vector[0])})
    run = docs.select.return_value.mapInArrow.call_args[0][0]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10_000)), "text": ["the whale", None, "sea 1"] * 3_333 + ["in"]})
    language._is_letter()
    tracemalloc.start()
    got = pa.Table.from_batches(list(run(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6, peak
    assert got.column("doc_id").to_pylist() == list(range(10_000))
    assert got.column("lang_pred").to_pylist() == (["en", "und", "en"] * 3_334)[:9_999] + ["en"]


def test_encoder_keeps_a_bounded_number_of_chunks(monkeypatch):
    """Ids stay the same while chunks move between the two halves of the cache."""
    words = [f"w{i}x" for i in range(300)] * 2
    want = tokens.Encoder().ids(" ".join(words))
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 40)
    few = tokens.Encoder()
    assert few.ids(" ".join(words)) == want
    few.ids(" ".join(words[:25]))
    assert len(few) <= 20 and len(few) + len(few.older) <= 40 and words[0] in few.keys() | few.older.keys()
