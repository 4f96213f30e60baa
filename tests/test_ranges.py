"""What a task keeps of a wide table's values."""

import numpy as np

from lakesift.dataset import least_different


def test_kept_values_hold_nothing_else():
    """A slice of the union of a batch's values kept all of that union in memory, for each feature."""
    kept = least_different(np.zeros(0), np.random.default_rng(8).random(400), 11)
    assert len(kept) == 11 and kept.base is None and (np.diff(kept) > 0).all()
    assert least_different(np.zeros(0), np.array([2.0] * 300 + [1.0, 3.0]), 11).tolist() == [1.0, 2.0, 3.0]
