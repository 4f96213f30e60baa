"""Relief scores against a plain pairwise loop, elimination, and what they refuse."""

import math
import warnings

import numpy as np
import pytest

from lakesift.operators import relief
from lakesift.operators.base import FittedSelector, NotFittedError, Selector
from lakesift.operators.relief import SURF, MultiSURF, ReliefF
from lakesift.operators.turf import TuRF
from lakesift.plans.catalogue import QUERIES

F1 = [(0.1, 5.0, 10.0, 3.0, 0), (0.2, 4.0, 10.0, 3.0, 0), (0.3, 6.0, 10.0, 3.0, 0), (10.8, 5.0, 20.0, 3.0, 1), (10.9, 4.0, 20.0, 3.0, 1), (11.0, 6.0, 20.0, 3.0, 1)]
F2 = [(1.1, 5.0, 10.0, 3.0, 0), (1.2, 4.0, 10.0, 3.0, 0), (2.3, 6.0, 10.0, 3.0, 0), (2.5, 5.5, 10.0, 3.0, 0), (1.5, 4.5, 20.0, 3.0, 0)]
F2 += [(8.8, 5.0, 20.0, 3.0, 1), (8.9, 4.0, 20.0, 3.0, 1), (9.5, 6.0, 20.0, 3.0, 1), (10.5, 4.5, 20.0, 3.0, 1), (10.5, 4.5, 10.0, 3.0, 1)]
NAMES = ["f0", "f1", "f2", "f3"]


def table(spark, rows, names=NAMES):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ["id", *names, "y"])


def plain(kind, x, y, limit, k=3, star=False):
    n, p = x.shape
    disc = [len(set(x[:, f])) <= limit for f in range(p)]
    span = [1.0 if d or np.ptp(x[:, f]) == 0 else np.ptp(x[:, f]) for f, d in enumerate(disc)]
    diff = [[[float(x[i, f] != x[j, f]) if disc[f] else abs(x[i, f] - x[j, f]) / span[f] for f in range(p)] for j in range(n)] for i in range(n)]
    scores = [0.0] * p
    for i in range(n):
        others = [j for j in range(n) if j != i]
        dist = {j: sum(diff[i][j]) for j in others}
        mean = sum(dist.values()) / (n - 1)
        if kind == "relieff":
            for c in set(y):
                mine = sorted((j for j in others if y[j] == c), key=lambda j: (dist[j], j))[:k]
                share = list(y).count(c) / n
                w = -1 / min(k, list(y).count(c)) if c == y[i] else share / (1 - list(y).count(y[i]) / n) / k
                for j in mine:
                    for f in range(p):
                        scores[f] += w * diff[i][j][f]
        elif kind == "surf":
            for j in others:
                near, miss = dist[j] < mean, y[i] != y[j]
                w = (1 if miss else -1) * (1 if near else (-1 if star else 0))
                for f in range(p):
                    scores[f] += w * diff[i][j][f]
        else:
            sd = math.sqrt(max(0.0, sum(d * d for d in dist.values()) / (n - 1) - mean * mean))
            near = {j for j in others if dist[j] < mean - sd / 2}
            n_miss, n_hit = sum(y[j] != y[i] for j in near), sum(y[j] == y[i] for j in near)
            for f in range(p):
                m = sum(diff[i][j][f] for j in near if y[j] != y[i])
                if star:
                    m -= sum(diff[i][j][f] for j in others if j not in near and y[j] != y[i])
                scores[f] += m / max(1, n_miss) - sum(diff[i][j][f] for j in near if y[j] == y[i]) / max(1, n_hit)
    return [s / n for s in scores]


@pytest.mark.parametrize("strategy", ["sql", "block", "rounds", "array"])
@pytest.mark.parametrize(("kind", "star"), [("relieff", False), ("surf", False), ("surf", True), ("multisurf", False), ("multisurf", True)])
def test_scores(spark, strategy, kind, star):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.random(24), rng.integers(0, 3, 24), rng.random(24) * 9, np.full(24, 2.0)])
    y = np.array([0] * 11 + [1] * 9 + [2] * 4)
    df = table(spark, [(*map(float, r), int(c)) for r, c in zip(x, y)])
    options = {"discrete_limit": 5, "strategy": "sql" if strategy == "sql" else "block"}
    if strategy == "rounds":
        options["block_bytes"] = 24 * 6 * 8 // 4  # four rounds a pass
    made = {"relieff": lambda: ReliefF(n_neighbors=5, **options), "surf": lambda: SURF(use_star=star, **options)}
    scorer = made.get(kind, lambda: MultiSURF(use_star=star, **options))()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        if strategy == "array":
            got = scorer.fit(df.selectExpr("id", "y", "array(f0, f1, f2, f3) as x"), "y", "x", "id")
            assert got.transform(df.selectExpr("array(f0, f1, f2, f3) as x")).first()["x"] == [x[0, got.top_features[0]]] and got.selected[0].startswith("x[")
        else:
            got = scorer.fit(df, "y", NAMES, "id")
    assert got.feature_importances == pytest.approx(plain(kind, x, y.tolist(), 5, 5, star), abs=1e-9)
    assert got.is_discrete == [False, True, False, True]


def test_ids_must_be_unique(spark):
    """With equal ids the ways would differ: which of the rows is the row itself? So they're refused, at every size."""
    rows = [(1, 0.0, 0), (1, 1.0, 0), (2, 2.0, 1), (3, 4.0, 1)]
    for ids in (rows, [(None, 0.0, 0), *rows[1:]]):
        df = spark.createDataFrame(ids, "id long, f0 double, y int")
        for strategy in ("auto", "block", "sql"):
            for scorer in (ReliefF(n_neighbors=1, strategy=strategy), SURF(strategy=strategy)):
                with pytest.raises(ValueError, match="unique"):
                    scorer.fit(df, "y", ["f0"], "id")


def test_text_ids_and_ties_in_every_way(spark):
    rows = [(f"r{k:02}", float(k % 2), float(k % 3), k % 2) for k in range(18)]
    df = spark.createDataFrame(rows, "id string, f0 double, f1 double, y int").repartition(5)
    for make in (lambda **o: ReliefF(n_neighbors=2, **o), lambda **o: SURF(use_star=True, **o), lambda **o: MultiSURF(**o)):
        got = [make(**o).fit(df, "y", ["f0", "f1"], "id").feature_importances for o in ({}, {"strategy": "sql"}, {"block_bytes": 150})]
        assert got[0] == pytest.approx(got[1], abs=1e-12) and got[0] == pytest.approx(got[2], abs=1e-12)


def test_elimination_prepares_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(relief, "prepare", lambda *a, real=relief.prepare: calls.append(1) or real(*a))
    df = table(spark, F2)
    model = TuRF(MultiSURF(strategy="block"), 1, 0.3).fit(df, "y", NAMES, "id")
    assert len(calls) == 1 and len(model.details["dropped"]) == 3
    assert TuRF(MultiSURF(), 1, 0.3).fit(df.selectExpr("id", "y", "array(f0, f1, f2, f3) as x"), "y", "x", "id").top_features == model.top_features


def test_known_rankings(spark):
    for scorer in (ReliefF(2, 4, n_neighbors=1), SURF(2, 3)):
        model = scorer.fit(table(spark, F1), "y", NAMES, "id")
        s = model.feature_importances
        assert s[0] > s[1] and s[2] > s[1] and s[3] == pytest.approx(0) and set(model.top_features) == {0, 2}
    model = MultiSURF(1, 4).fit(table(spark, F2), "y", NAMES, "id")
    assert model.top_features == [0] and model.feature_importances[3] == pytest.approx(0)
    out = model.transform(table(spark, F2), keep=["id"])
    assert out.columns == ["id", "f0"] and out.count() == 10
    back = model.inverse_transform(out, keep=["id"])
    assert back.columns == ["id", *NAMES] and back.first()["f2"] == 0.0 and back.where("id = 5").first()["f0"] == 8.8
    scores = model.scores(spark).collect()
    assert {r["rank"] for r in scores} == {1, 2, 3, 4} and next(r["feature"] for r in scores if r["rank"] == 1) == "f0"


def test_single_class(spark):
    df = table(spark, [(*r[:-1], 0) for r in F1])
    assert ReliefF(2, n_neighbors=2).fit(df, "y", NAMES, "id").top_features == [0, 1]
    assert ReliefF(n_neighbors=2).fit(df, "y", NAMES, "id").feature_importances == [0.0] * 4
    for scorer in (SURF(discrete_limit=3), MultiSURF(discrete_limit=3)):
        assert max(scorer.fit(df, "y", NAMES, "id").feature_importances) <= 0


def test_string_labels_give_the_same(spark):
    df = table(spark, F1)
    text = df.selectExpr("id", *NAMES, "concat('c', y) as y")
    one, two = (SURF(discrete_limit=3).fit(d, "y", NAMES, "id").feature_importances for d in (df, text))
    assert one == pytest.approx(two)


def test_refusals(spark):
    df = table(spark, F1)
    with pytest.warns(UserWarning, match="smallest class"):
        ReliefF(n_neighbors=5).fit(df, "y", NAMES, "id")
    for bad in (ReliefF(n_neighbors=0), ReliefF(n_neighbors=6), SURF(n_features_to_select=9), SURF(strategy="gpu"), MultiSURF(n_features_to_select=0.0), SURF(discrete_limit=0)):
        with pytest.raises(ValueError):
            bad.fit(df, "y", NAMES, "id")
    with pytest.raises(TypeError):
        SURF(n_features_to_select="2").fit(df, "y", NAMES, "id")
    with pytest.raises(ValueError, match="NaN"):
        SURF().fit(table(spark, [(float("nan"), *F1[0][1:]), *F1]), "y", NAMES, "id")
    with pytest.raises(ValueError, match="at least 2"):
        SURF().fit(df.limit(1), "y", NAMES, "id")
    with pytest.raises(ValueError, match="id column"):
        SURF().fit(df, "y", NAMES)
    with pytest.raises(NotFittedError):
        SURF().transform(df)
    fitted = SURF()
    fitted.fit(df, "y", NAMES, "id")
    with pytest.raises(ValueError, match="X has 3 features, but SURF is expecting 4"):
        fitted.transform(df, feature_cols=NAMES[:3])


class Falling(Selector):
    """Importances that fall from 1 to 0 in the order of the features."""

    calls = 0

    def get_params(self):
        return {}

    def clone(self):
        return self

    def fit_frame(self, frame):
        self.calls += 1
        return FittedSelector(frame.feature_cols, [0], np.linspace(1, 0, frame.n_features).tolist())


@pytest.mark.parametrize(
    ("p", "options", "kept"),
    [(20, {"n_features_to_select": 5}, 5), (20, {"n_features_to_select": 7}, 7), (20, {"n_iterations": 1}, 18), (6, {"n_features_to_select": 1, "pct_remove": 0.001}, 1), (11, {"pct_remove": 0.2}, 10), (4, {}, 4)],
)
def test_elimination(spark, p, options, kept):
    names = [f"f{k}" for k in range(p)]
    df = spark.createDataFrame([(k, *[float(k)] * p, k % 2) for k in range(4)], ["id", *names, "y"])
    model = TuRF(Falling(), **options).fit(df, "y", names, "id")
    assert model.top_features == list(range(kept)) and len(model.feature_importances) == p


def test_elimination_refusals(spark):
    df = table(spark, F1)
    for pct in (0, 1, 1.1):
        with pytest.raises(ValueError):
            TuRF(Falling(), pct_remove=pct).fit(df, "y", NAMES, "id")
    with pytest.raises(ValueError):
        TuRF(Falling(), 0).fit(df, "y", NAMES, "id")
    assert TuRF(SURF(3, 3), 2, 0.5).fit(df, "y", NAMES, "id").top_features == [0, 2]


def test_parameters():
    scorer = ReliefF(n_neighbors=7)
    assert scorer.get_params()["n_neighbors"] == 7 and scorer.clone() == scorer
    assert scorer.set_params(n_neighbors=2).n_neighbors == 2
    with pytest.raises(ValueError):
        scorer.set_params(k=2)


def test_whole_embeddings(spark, tmp_path):
    random = np.random.default_rng(5)
    x, y = random.normal(size=(40, 64)).astype("f4").astype("f8"), [k % 3 for k in range(40)]
    x[:, 50] += y
    rows = [(k, [float(v) for v in x[k]], y[k]) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, kind in (("relieff_embeddings", "relieff"), ("multisurf_embeddings", "multisurf")):
        got = {r["feature_idx"]: r["score"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert [got[f] for f in range(64)] == pytest.approx(plain(kind, x, y, 10, 5), abs=1e-5)
    left = list(range(64))
    while len(left) > 8:
        scores = plain("multisurf", x[:, left], y, 10)
        left = [f for _, f in sorted(zip(scores, left))[min(max(1, int(len(left) * 0.5)), len(left) - 8) :]]
    got = QUERIES["turf_multisurf"](spark, str(tmp_path)).collect()
    assert len(got) == 64 and {r["feature_idx"] for r in got if r["survives"]} == set(left) and 50 in left
