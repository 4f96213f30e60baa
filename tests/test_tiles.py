"""The sizes of tiles of pairs, and the nearest rows in them."""

import numpy as np
import pyarrow as pa

from lakesift.operators import relief


class Sent:
    def __init__(self, *value):
        self.value = value


def test_tiles_stay_small():
    """A tile of four million distances, with as large temporaries for each feature, went through memory once for every feature."""
    rng = np.random.default_rng(7)
    keys, y, x = rng.permutation(3000), np.sort(rng.integers(0, 3, 3000)), rng.random((4, 3000))
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(y.astype("i4")), pa.array(list(x.T))], names=["key", "y", "x"])
    rows = 0
    for my_keys, _, _, dist, _, _, mine, _ in relief._tiled(iter([batch]), Sent(keys, y, x), None, [False, True, False, False]):
        assert dist.size <= 1 << 18
        k = np.arange(rows, rows + len(my_keys))
        expected = np.abs(mine[:, 0, None] - x[0]) + (mine[:, 1, None] != x[1]) + np.abs(mine[:, 2, None] - x[2]) + np.abs(mine[:, 3, None] - x[3])
        expected[np.arange(len(k)), k] = np.inf
        assert (dist == expected).all()
        rows += len(k)
    assert rows == 3000


def test_nearest_of_ties():
    dist = np.array([[1.0, 2.0, 1.0, 1.0, 0.5], [np.inf, 3.0, 3.0, 3.0, 3.0], [np.inf, np.inf, np.inf, 1.0, np.inf]])
    row, col = relief._nearest(dist, 3)
    assert sorted(zip(row.tolist(), col.tolist())) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 2), (1, 3), (2, 3)]
