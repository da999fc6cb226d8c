"""What sampling costs: calls on arrays don't grow with the texts of a slice."""

import numpy as np

from gondola.llm import segmentation


def test_scalar_draws_are_those_of_arrays():
    for seed in (0, 7, 2**63 + 11, 2**64 - 1):
        for counter in (0, 1, (1 << 62) + 5):
            assert segmentation._one_uniform(seed, counter) == segmentation.uniform(np.array([seed], np.uint64), np.array([counter], np.int64))[0]


def test_array_draws_do_not_grow_with_texts(monkeypatch):
    calls, whole = [], segmentation.uniform
    monkeypatch.setattr(segmentation, "uniform", lambda *a: calls.append(1) or whole(*a))
    vocab = segmentation.vocabulary(segmentation.model_path(), segmentation.TEMPERATURE)
    used = []
    for n in (10, 200):
        calls.clear()
        segmentation.sampled(list(range(n)), ["the internationalisation of shelf prices"] * n, vocab, 3)
        used.append(len(calls))
    assert used[1] < used[0] + 60
