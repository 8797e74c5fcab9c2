"""A bucket scales the tables of other pairs only, never those of the pair or dish itself."""

import numpy as np
import pytest

from quillspan.llm import pitman_yor


@pytest.mark.parametrize("share", [43, 2500])
def test_pairs_alone_in_their_context(share):
    """The words are divided over the buckets, so that their base probabilities are the same with one or many."""
    n = 20_000
    dish, context, c = np.arange(n) % 100, np.arange(n), np.full(n, 2)
    kept = [pitman_yor.seat(1, dish, context, c, np.ones(100, bool), k, pitman_yor.Settings()).kept.mean() for k in (1, share)]
    assert abs(kept[0] - kept[1]) < 0.03
