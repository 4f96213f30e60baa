"""Relief scores of rows on few lines."""

import warnings

import numpy as np
import pytest

from lakesift.operators import lines, relief
from lakesift.operators.relief import SURF, MultiSURF, ReliefF
from tests.test_relief import plain, table

KINDS = {
    "relieff": lambda **o: ReliefF(n_neighbors=4, **o),
    "surf": SURF,
    "surf*": lambda **o: SURF(use_star=True, **o),
    "multisurf": MultiSURF,
    "multisurf*": lambda **o: MultiSURF(use_star=True, **o),
}


def rows_on_lines(seed, n=200):
    """Six lines, with equal rows, ties, a class that one line lacks, and a class of two rows."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.round(rng.normal(size=n), 1) * 3.7, rng.integers(0, 3, n), rng.integers(0, 2, n) * 7.0])
    y = np.where(x[:, 1] == 2, 0, rng.integers(0, 3, n))
    y[:2] = 3
    return x, y


@pytest.mark.parametrize("kind", KINDS)
def test_no_pairs_where_lines_are_few(spark, monkeypatch, kind):
    """Neither a join of pairs nor rounds: those ran in time that grows with the square of the rows."""

    def refuse(*_, **__):
        raise AssertionError("pairs were formed")

    x, y = rows_on_lines(4)
    df = table(spark, [(*map(float, r), int(c)) for r, c in zip(x, y)], ["f0", "f1", "f2"])
    monkeypatch.setattr(relief, "_pairs", refuse)
    monkeypatch.setattr(relief.Blocks, "_round", refuse)
    expected = plain(kind.rstrip("*"), x, y.tolist(), 5, 4, kind.endswith("*"))
    for options in ({"strategy": "sql"}, {"block_bytes": 200}) if kind == "relieff" else ({"strategy": "sql"},):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            got = KINDS[kind](discrete_limit=5, **options).fit(df, "y", ["f0", "f1", "f2"], "id")
        assert got.feature_importances == pytest.approx(expected, abs=1e-9)


def test_one_block_of_many_pairs_goes_by_lines(spark, monkeypatch):
    x, y = rows_on_lines(5)
    df = table(spark, [(*map(float, r), int(c)) for r, c in zip(x, y)], ["f0", "f1", "f2"])
    monkeypatch.setattr(relief, "PAIRS_AT_MOST", 0)
    monkeypatch.setattr(relief.Blocks, "scores", None)
    got = SURF(discrete_limit=5).fit(df, "y", ["f0", "f1", "f2"], "id")
    assert got.feature_importances == pytest.approx(plain("surf", x, y.tolist(), 5), abs=1e-9)


def test_many_lines_are_left_to_pairs(spark):
    rng = np.random.default_rng(6)
    df = table(spark, [(*map(float, r), 0) for r in rng.random((100, 2))], ["f0", "f1"])
    frame = relief.FeatureFrame.of(df, "y", ["f0", "f1"], "id")
    assert lines.find(relief.prepare(frame, 10, 100)[0]) is None


def test_values_too_close_to_tell_are_left_to_pairs(spark):
    """Different values can give equal distances there, and then ids decide; ranks by value wouldn't do."""
    x = [(k % 40) * 1e-17 if k else 1.0 for k in range(80)]
    df = table(spark, [(v, k % 2) for k, v in enumerate(x)], ["f0"])
    frame = relief.FeatureFrame.of(df, "y", ["f0"], "id")
    assert lines.scores(relief.prepare(frame, 10, 80)[0], "relieff", 3, False) is None
    got = ReliefF(strategy="sql").fit(df, "y", ["f0"], "id").feature_importances
    assert got == pytest.approx(ReliefF().fit(df, "y", ["f0"], "id").feature_importances, abs=1e-15)
