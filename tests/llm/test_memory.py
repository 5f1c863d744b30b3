"""What a Python worker holds during a task and after it."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidepool.llm import common, nbsvm


def test_words_that_do_not_come_back_are_not_all_remembered():
    texts = [b" ".join(b"w%d" % n for n in range(k, k + 1000)) for k in range(0, 300_000, 1000)]
    features = nbsvm.Features()
    tracemalloc.start()
    for t in texts:
        last = features(t)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40e6
    assert np.array_equal(last, nbsvm.Features()(texts[-1]))


def test_lean_passes_all_batches_and_gives_back_at_the_end(monkeypatch):
    ended = []
    monkeypatch.setattr(common, "give_back", lambda: ended.append(len(got)))
    got = []
    for b in common.lean(lambda batches: (b.slice(1) for b in batches))(iter([pa.record_batch({"a": [n, n + 1]}) for n in range(3)])):
        got.append(b.column(0).to_pylist())
    assert got == [[1], [2], [3]] and ended == [3]


def test_give_back():
    common.give_back()
