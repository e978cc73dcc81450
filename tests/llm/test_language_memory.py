"""What a scoring task of op1_language holds at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np

from scholarflow.llm import op1_language


def test_scoring_holds_few_grams_at_a_time():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 5000))) for _ in range(400)]
    grams = np.unique(op1_language._grams(np.frombuffer(texts[0].encode(), np.uint8)))
    low = np.ones((1 << 16, 2), np.float32)
    model = op1_language.Model(["a", "b"], low, np.array([0]), [""])
    model.kept[0] = op1_language._slice_costs(grams.astype(np.int64), np.zeros(len(grams), np.int64), np.ones(len(grams), np.int64), low)
    tracemalloc.start()
    try:
        bits = model.bits_of(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(bits) == 400 and all(n == 5000 for _, n in bits)
    assert peak < 40 << 20
