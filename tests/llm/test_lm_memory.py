"""A unit of the language-model scores takes a bounded number of bytes a word in a task."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard

from taquilla.llm import lm_score


def test_a_unit_is_scored_in_few_bytes_a_word(monkeypatch):
    monkeypatch.setattr(lm_score, "AT_ONCE", 1 << 14, raising=False)
    rng = random.Random(5)
    texts = [b"\n".join(b"w%d" % rng.randrange(2_000) for _ in range(1_000)) for _ in range(300)]
    data = zstandard.ZstdCompressor().compress(b"\n\n".join([*texts, b""]))
    tracemalloc.start()
    words, sizes = lm_score._hashed_words(data, 301)
    grams = lm_score.Grams(words, sizes)
    counts = []
    for order in range(1, 4):
        n = np.unique(grams.of(order)[0], return_counts=True)[1]
        counts.append({"gram": order, "bucket": 0, "totals": lm_score._squeezed(n + 1)})
    del words, sizes, grams
    unit = pa.table({"ids": pa.array([list(range(301))]), "texts": pa.array([data], pa.binary())})
    tracemalloc.reset_peak()
    found = lm_score._scored_unit(unit, pa.Table.from_pylist(counts), 400_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.column("n_words").to_pylist() == [1_000] * 300 + [0]
    assert found.column("n_order_3")[0].as_py() == 998  # every count is one above the own ones
    assert peak < 200 * 300_000  # it was 247 bytes a word with lists of words and two sorts an order
