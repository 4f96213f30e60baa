"""chi-squared, information, binning, mRMR and CFS on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesift.dataset import FeatureFrame
from lakesift.functions.binning import binned, exact_quantiles, quantile_edges
from lakesift.functions.information import mutual_information, symmetrical_uncertainty
from lakesift.functions.selection import ranked, selection_count
from lakesift.functions import stats
from lakesift.functions.stats import chi2_sf_value
from lakesift.operators import contingency
from lakesift.operators.base import NotFittedError
from lakesift.operators.cfs import CFS, prune, search
from lakesift.operators.chi2 import chi2, chi2_of_sums, class_sums
from lakesift.operators.contingency import cells, mi_matrices, mi_pair, su_matrices
from lakesift.operators.mrmr import MRMR, best_candidate


def frame(spark, rows, names):
    return spark.createDataFrame([tuple(map(lambda v: v.item() if hasattr(v, "item") else v, r)) for r in rows], names)


def mi(x, y):
    n, out = len(x), 0.0
    for a in set(x):
        for b in set(y):
            p = sum(1 for u, v in zip(x, y) if (u, v) == (a, b)) / n
            if p > 1e-12:
                out += p * math.log2(p / (list(x).count(a) / n * (list(y).count(b) / n) + 1e-12))
    return out


def test_selection_count_and_ranking():
    assert [selection_count(s, 10) for s in (0.2, 0.05, 1.0, 3)] == [2, 1, 10, 3]
    for bad in (0.0, 1.5, 0, 11):
        with pytest.raises(ValueError):
            selection_count(bad, 10)
    for bad in (True, "3", None):
        with pytest.raises(TypeError):
            selection_count(bad, 10)
    assert ranked([1.0, 3.0, 1.0]) == [1, 2, 0]


def test_survival_function():
    assert chi2_sf_value(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf_value(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf_value(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf_value(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf_value(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)


@pytest.mark.parametrize("dof", [2, 3, 20, 21, 22, 999, 1000, 1500, 4999, 9998, 9999])
def test_survival_function_of_many_classes(spark, dof):
    """Finite, falling, about a half at the middle, and between its neighbours, whether the degrees are even or odd."""
    at = np.array([0.0, dof / 2, dof - 2 / 3, dof, dof * 1.5, dof * 4.0])
    got, less, more = (stats.chi2_sf_values(at, d) for d in (dof, dof - 1, dof + 1))
    assert np.isfinite(got).all() and got[0] == 1.0 and (np.diff(got) <= 1e-12).all()
    assert (less <= got + 1e-12).all() and (got <= more + 1e-12).all()
    if dof > 2:
        assert got[2] == pytest.approx(0.5, abs=0.02)
    df = spark.createDataFrame([(float(x),) for x in at], "x double")
    assert [r[0] for r in df.select(stats.chi2_sf(F.col("x"), dof)).collect()] == pytest.approx(got.tolist(), rel=1e-9, abs=1e-300)


def test_chi2_of_many_classes(spark):
    rows = [(float(1 + (k * 7919) % 13), float(k % 5000), k % 5000) for k in range(10_000)]
    got = chi2(spark.createDataFrame(rows, "a double, b double, y int"), "y", ["a", "b"]).orderBy("feature_idx").collect()
    assert all(0 <= r["p_value"] <= 1 and math.isfinite(r["chi2"]) for r in got) and got[0]["p_value"] > 0 and got[1]["p_value"] == 0


def test_chi2_of_an_array_column(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 20, (50, 30)).astype(float), rng.integers(0, 3, 50)
    names = [f"c{k}" for k in range(30)]
    wide = spark.createDataFrame([(*map(float, r), f"k{c}") for r, c in zip(x, y)], [*names, "y"])
    arrays = wide.select("y", F.array(*names).alias("x"))
    one, two = (chi2(df, "y", f).orderBy("feature_idx").collect() for df, f in ((wide, names), (arrays, "x")))
    assert [r["chi2"] for r in one] == pytest.approx([r["chi2"] for r in two]) and [r["p_value"] for r in one] == pytest.approx([r["p_value"] for r in two])
    assert two[7]["feature"] == "x[7]"
    for bad, match in ((F.array(F.lit(1.0), F.lit(None)), "NaN"), (F.array(F.lit(-1.0), F.lit(2.0)), "non-negative"), (F.lit(None).cast("array<double>"), "NaN")):
        with pytest.raises(ValueError, match=match):
            chi2(arrays.withColumn("x", bad), "y", "x")
    with pytest.raises(ValueError, match="one length"):
        chi2(arrays.withColumn("x", F.when(F.col("y") == "k0", F.array(F.lit(1.0))).otherwise(F.col("x"))), "y", "x")


def test_ranges_are_those_of_the_profile(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(v), float(v % 7), float(k % 3), k % 2) for k, v in enumerate(rng.integers(0, 500, 900))], "a double, b double, c double, y int").repartition(4)
    for frame in (FeatureFrame.of(df, "y", ["a", "b", "c"]), FeatureFrame.of(df.selectExpr("y", "array(a, b, c) as x"), "y", "x")):
        for limit in (1, 2, 3, 6, 7, 10):
            one = frame.profile(limit).select("feature_idx", "low", "high", "is_discrete")
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, frame.ranges(limit).collect()))


def test_class_sums(spark):
    df = frame(spark, [(1, 2, 0, 0), (3, 0, 5, 1), (0, 4, 1, 0), (2, 2, 3, 1)], ["f0", "f1", "f2", "y"])
    got = {r["label"]: [r["s0"], r["s1"], r["s2"]] for r in class_sums(FeatureFrame.of(df, "y", ["f0", "f1", "f2"])).collect()}
    assert got == {0: [1, 6, 1], 1: [5, 2, 8]}


@pytest.mark.parametrize(
    ("observed", "rows", "expected"),
    [([[30, 10, 20], [10, 30, 0]], [60, 40], [3.75, 20.41666667, 13.33333333]), ([[10, 0, 20], [15, 0, 5]], [30, 20], [None, 0.0, None])],
)
def test_chi2_of_sums(spark, observed, rows, expected):
    sums = spark.createDataFrame([(float(n), *map(float, o)) for n, o in zip(rows, observed)], ["n", "s0", "s1", "s2"])
    got = [r["chi2"] for r in chi2_of_sums(sums, ["a", "b", "c"], 2).orderBy("feature_idx").collect()]
    for g, e in zip(got, expected):
        assert g > 0 if e is None else g == pytest.approx(e)


@pytest.mark.parametrize("classes", [1, 2, 3, 4])
def test_chi2_against_numpy(spark, classes):
    rng = np.random.default_rng(classes)
    x, y = rng.integers(0, 100, (60, 3)), rng.integers(0, classes, 60)
    x[:, 2] = 0
    got = chi2(frame(spark, [(*r, c) for r, c in zip(x, y)], ["a", "b", "c", "y"]), "y", ["a", "b", "c"]).orderBy("feature_idx").collect()
    for k, r in enumerate(got):
        stat, total = 0.0, x[:, k].sum()
        for c in set(y.tolist()):
            e = (y == c).sum() * total / 60
            stat += (x[y == c, k].sum() - e) ** 2 / e if e > 1e-12 and classes > 1 else 0.0
        assert r["chi2"] == pytest.approx(stat, rel=1e-9, abs=1e-12)
        assert r["p_value"] == pytest.approx(chi2_sf_value(stat, len(set(y.tolist())) - 1) if classes > 1 else 1.0, rel=1e-6)


def test_chi2_rejects(spark):
    with pytest.raises(ValueError, match="non-negative"):
        chi2(frame(spark, [(-1.0, 0), (1.0, 1)], ["a", "y"]), "y", ["a"])
    with pytest.raises(ValueError, match="NaN"):
        chi2(frame(spark, [(float("nan"), 0), (1.0, 1)], ["a", "y"]), "y", ["a"])
    with pytest.raises(ValueError, match="infinity"):
        chi2(frame(spark, [(float("inf"), 0), (1.0, 1)], ["a", "y"]), "y", ["a"])
    with pytest.raises(ValueError, match="no such"):
        chi2(frame(spark, [(1.0, 0)], ["a", "y"]), "y", ["b"])


def test_mutual_information(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (80, 3))
    y = (x[:, 0] + rng.integers(0, 2, 80)) % 3
    df = frame(spark, [(*r, c) for r, c in zip(x, y)], ["a", "b", "c", "y"])
    assert mi_pair(df, "a", "y").first()["mi"] == pytest.approx(mi(x[:, 0].tolist(), y.tolist()))
    assert mi_pair(df, "a", "y", "nat").first()["mi"] == pytest.approx(mi(x[:, 0].tolist(), y.tolist()) * math.log(2))
    both = [mi_matrices(df, "y", ["a", "b", "c"], strategy=s) for s in ("sql", "gram")]
    for k in (0, 1):
        one, two = ({tuple(r)[:-1]: r["mi"] for r in b[k].collect()} for b in both)
        assert one.keys() == two.keys()
        assert all(one[i] == pytest.approx(two[i], abs=1e-9) for i in one)
    assert {tuple(r)[:2]: r["mi"] for r in both[0][1].collect()}[0, 1] == pytest.approx(mi(x[:, 0].tolist(), x[:, 1].tolist()))
    with pytest.raises(ValueError):
        mi_pair(df.withColumn("a", F.lit(-1)), "a", "y")
    with pytest.raises(ValueError):
        mi_pair(df.withColumn("a", F.lit(0.5)), "a", "y")
    with pytest.raises(ValueError):
        mi_pair(df, "a", "y", "ban")


def test_symmetrical_uncertainty_limits(spark):
    df = spark.createDataFrame([(k % 4, k % 4, 7, k // 4) for k in range(16)], ["a", "b", "c", "d"])
    got = {r["pair"]: r["su"] for r in symmetrical_uncertainty(cells(df, [("a", "b"), ("a", "c"), ("c", "c"), ("a", "d")])).collect()}
    assert [got[k] for k in range(4)] == pytest.approx([1.0, 0.0, 0.0, 0.0], abs=1e-12)


def test_bins(spark):
    df = spark.createDataFrame([(float(k), 5.0) for k in range(10)], ["x", "c"])
    assert [r["x"] for r in binned(df, ["x", "c"], 5).orderBy("x").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert {r["c"] for r in binned(df, ["c"], 5).collect()} == {0}
    assert sorted(r["x"] for r in binned(df, ["x"], 5, "quantile").collect()) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    two = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.2, 9.8, 9.9, 10.0)], ["x"])
    assert [r["x"] for r in binned(two, ["x"], 2, "kmeans").collect()] == [0, 0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        binned(df, ["x"], 5, "log")


def test_quantiles_by_ranks(spark):
    rng = np.random.default_rng(3)
    values = [*rng.normal(size=500).round(2).tolist(), *[1.5] * 200, *[-7.0] * 3]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    at = [k / 10 for k in range(11)]
    assert exact_quantiles(df, "x", at) == pytest.approx(np.quantile(values, at).tolist())
    known = df.where("x is not null")
    assert quantile_edges(known, ["x"], 7, 10)["x"] == pytest.approx(quantile_edges(known, ["x"], 7)["x"])


def slow_kmeans(x, n):
    """Lloyd's rounds on one column, from the middles of uniform bins; an empty bin keeps its centre."""
    low, high = min(x), max(x)
    centres = [low + (high - low) * (k + 0.5) / n for k in range(n)]
    for _ in range(300):
        bins = [sum((a + b) / 2 <= v for a, b in zip(centres, centres[1:])) for v in x]
        moved = [float(np.mean([v for v, b in zip(x, bins) if b == k])) if k in bins else centres[k] for k in range(n)]
        if max(abs(a - b) for a, b in zip(moved, centres)) <= 1e-9 * max(1.0, high - low):
            return bins
        centres = sorted(moved)
    return bins


@pytest.mark.parametrize("n", [2, 5, 9])
def test_kmeans_bins_against_a_loop(spark, n):
    rng = np.random.default_rng(n)
    x = [*rng.normal(0, 1, 60).tolist(), *rng.normal(9, 0.5, 30).tolist(), 40.0]
    got = binned(spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, x double"), ["x"], n, "kmeans").orderBy("k").collect()
    assert [r["x"] for r in got] == slow_kmeans(x, n)


def test_cells_with_nulls_many_values_and_flushes(spark, monkeypatch):
    rows = [(k % 50, (k * 7) % 40, None if k % 9 == 0 else k % 3, f"t{k % 4}") for k in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d string").repartition(3)
    pairs = [("a", "b"), ("c", "d"), ("a", "a")]
    expected = {}
    for r in rows:
        for k, (u, v) in enumerate(pairs):
            key = (k, *(None if r["abcd".index(c)] is None else str(r["abcd".index(c)]) for c in (u, v)))
            expected[key] = expected.get(key, 0) + 1
    for most in (10, 2_000_000):
        monkeypatch.setattr(contingency, "HELD_CELLS", most)
        assert {(r["pair"], r["x"], r["y"]): r["n"] for r in cells(df, pairs).collect()} == expected
    got = mutual_information(cells(df, pairs)).orderBy("pair").collect()
    for k, (u, v) in enumerate(pairs):
        assert got[k]["mi"] == pytest.approx(mi([r["abcd".index(u)] for r in rows], [r["abcd".index(v)] for r in rows]))


def planted(spark):
    rng = np.random.default_rng(42)
    y = rng.integers(0, 2, 200)
    x = rng.integers(0, 3, (200, 10))
    x[:, 0] = np.where(rng.random(200) < 0.1, 1 - y, y)
    x[:, 1] = x[:, 0]
    x[:, 9] = np.where(rng.random(200) < 0.05, 1 - y, y)
    names = [f"f{k}" for k in range(10)]
    return frame(spark, [(*r, c) for r, c in zip(x, y)], [*names, "y"]), names


def test_mrmr(spark):
    df, names = planted(spark)
    model = MRMR(2).fit(df, "y", names)
    # The second is no copy of the first, and it is the other informative feature or one that is not redundant.
    assert model.top_features[0] == 9
    assert len(model.top_features) == 2 and model.transform(df, keep=["y"]).columns == ["y", *model.selected]
    assert MRMR(3, "MIQ").fit(df, "y", names).top_features[0] == 9
    for bad in (0, 11):
        with pytest.raises(ValueError):
            MRMR(bad).fit(df, "y", names)
    with pytest.raises(ValueError):
        MRMR(2, "XYZ")
    with pytest.raises(ValueError):
        MRMR(1).fit(df.withColumn("f0", F.col("f0") + 0.5), "y", names)
    with pytest.raises(NotFittedError):
        MRMR(2).transform(df)


def test_whole_redundancy_matrix(spark):
    df, names = planted(spark)
    for method in ("MID", "MIQ"):
        one, two = MRMR(4, method).fit(df, "y", names), MRMR(4, method, redundancy="all").fit(df, "y", names)
        assert one.top_features == two.top_features and one.details["step_scores"] == pytest.approx(two.details["step_scores"])
    matrix = two.details["redundancy_matrix"]
    rows = df.collect()
    assert len(matrix) == 10 and all(matrix[i][j] == matrix[j][i] for i in range(10) for j in range(10)) and matrix[3][3] == 0.0
    assert matrix[2][7] == pytest.approx(mi([r["f2"] for r in rows], [r["f7"] for r in rows])) and len(two.details["redundancy"]) == 45
    with pytest.raises(ValueError):
        MRMR(2, redundancy="some")


def test_su_matrices_in_both_ways(spark):
    df, names = planted(spark)
    both = [su_matrices(df, "y", names, s) for s in ("sql", "gram")]
    for k in (0, 1):
        one, two = ({tuple(r)[:-1]: r["su"] for r in b[k].collect()} for b in both)
        assert one.keys() == two.keys() and len(one) == (10, 45)[k] and all(one[i] == pytest.approx(two[i], abs=1e-12) for i in one)
    plain = {r["pair"]: r["su"] for r in symmetrical_uncertainty(cells(df, [(names[0], names[1])])).collect()}
    assert one[0, 1] == pytest.approx(plain[0]) == pytest.approx(1.0)


def test_mrmr_near_ties():
    assert best_candidate({1: 0.5, 2: 0.5 + 1e-13, 3: 0.1}, {1: 0.2, 2: 0.3, 3: 0.0}) == 1
    assert best_candidate({1: 0.5, 2: 0.5}, {1: 0.2, 2: 0.2}) == 1


def test_cfs(spark):
    rng = np.random.RandomState(42)
    y = rng.randint(0, 2, 200)
    f0 = y + rng.normal(0, 0.1, 200)
    x = np.column_stack([f0, f0 + rng.normal(0, 0.05, 200), rng.random(200) * 10, np.full(200, 5.0)])
    df = frame(spark, [(*r, c) for r, c in zip(x, y)], ["a", "b", "c", "d", "y"])
    model = CFS().fit(df, "y", ["a", "b", "c", "d"])
    assert set(model.top_features) <= {0, 1} and len(model.top_features) == 1
    assert model.details["merit"] > 0 and model.support().count(True) == 1
    none = CFS().fit(df, "y", ["c", "d"])
    assert none.top_features == [] and none.details["merit"] == 0
    with pytest.raises(ValueError):
        CFS(binning="log")
    with pytest.raises(ValueError):
        CFS().fit(df.limit(1), "y", ["a"])


def test_cfs_search_and_prune():
    r_cf, r_ff = [0.5, 0.4, 0.05, 0.3], {(0, 1): 0.45, (0, 3): 0.0, (1, 3): 0.0}
    # merit 0.5, then 0.8 / sqrt(2), then 1.2 / sqrt(3 + 2 * 0.45)
    assert search(r_cf, r_ff) == [0, 3, 1]
    assert search([0.09, 0.01], {}) == []
    assert prune([0, 1, 3], r_cf, r_ff) == [0, 3]
    assert search([], {}) == []


def test_profile(spark):
    rows = [(float(i), float(i % 3), int(k)) for k in (0, 1) for i in range(11)]
    df = spark.createDataFrame(rows, ["a", "b", "y"])
    assert [r["is_discrete"] for r in FeatureFrame.of(df, "y", ["a", "b"]).profile(10).orderBy("feature_idx").collect()] == [False, True]
    assert [r["is_discrete"] for r in FeatureFrame.of(df, "y", ["a", "b"]).profile(12).collect()] == [True, True]
