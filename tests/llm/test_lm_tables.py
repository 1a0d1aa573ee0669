import numpy as np

from quillgrid.llm import lm


def test_histories_spread_over_the_trigram_table():
    rows = lm.Weights().rows(np.arange(lm.Size().codes ** 2))[2]
    shared = np.bincount(rows - rows.min())
    assert len(shared) == 8192 and 0 < shared.min() and shared.max() < 100
