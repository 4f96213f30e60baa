"""Interactions, pipeline stages, streams, and the catalogue against SQL."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import ParamGridBuilder

from lakesift.ml import InteractionStage, SelectorStage
from lakesift.operators.base import NotFittedError
from lakesift.operators.chi2 import chi2
from lakesift.operators.mdr import MDR, balanced_accuracy, cell_counts, with_folds
from lakesift.operators.mrmr import MRMR
from lakesift.operators.relief import SURF, ReliefF
from lakesift.operators.turf import TuRF
from lakesift.plans import catalogue
from lakesift.streaming import stream_chi2, stream_relevance

F8 = [(2, 2, 1), (2, 2, 1), (2, 0, 0), (0, 2, 0), (0, 0, 0), (1, 1, 0), (1, 0, 0), (0, 1, 0)]
DATA = "/root/testdata/sf0.001"


def genes(spark, rows, p=2):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ["id", *[f"f{k}" for k in range(p)], "y"])


def test_mdr_finds_the_pair(spark):
    df = genes(spark, F8)
    search = MDR(2, 2)
    model = search.fit(df, "y", ["f0", "f1"], "id")
    assert model.best_interaction == (0, 1) and model.best_cvc == 2 and model.best_mean_testing_ba == 1.0
    assert [r["prediction"] for r in search.predict(df).orderBy("id").collect()] == [r[-1] for r in F8]
    assert model.score(df, "y") == 1.0 and "mdr" in model.transform(df).columns
    with pytest.raises(NotImplementedError):
        model.predict_proba(df)
    # A cell that no row fell into predicts 0.
    assert model.predict(genes(spark, [(1, 2, 0)])).first()["prediction"] == 0


@pytest.mark.parametrize("k", [1, 3])
def test_accuracy_against_a_loop(spark, k):
    rng = np.random.default_rng(k)
    rows = [(*map(int, rng.integers(0, 3, 4)), int(rng.integers(0, 2))) for _ in range(50)]
    df = genes(spark, rows, 4)
    cases = sum(r[-1] for r in rows)
    got = {r["combo"]: r["ba"] for r in balanced_accuracy(cell_counts(df, ["f0", "f1", "f2", "f3"], k), *map(__import__("pyspark").sql.functions.lit, (cases, 50 - cases))).collect()}
    for n, combo in enumerate(itertools.combinations(range(4), k)):
        tp = tn = 0
        for cell in itertools.product(range(3), repeat=k):
            inside = [r for r in rows if tuple(r[f] for f in combo) == cell]
            a, b = sum(r[-1] for r in inside), sum(1 - r[-1] for r in inside)
            high = b == 0 or a / b > cases / (50 - cases)
            tp, tn = tp + (a if high else 0), tn + (0 if high else b)
        assert got[n] == pytest.approx((tp / cases + tn / (50 - cases)) / 2)


def test_pairs_by_products_are_those_by_counting(spark):
    rng = np.random.default_rng(11)
    rows = genes(spark, [(*map(int, rng.integers(0, 3, 5)), int(rng.integers(0, 2))) for _ in range(90)], 5).repartition(3)
    names = [f"f{k}" for k in range(5)]
    dealt = with_folds(rows, "y", "id", 4)
    one, two = (sorted(map(tuple, MDR(2, 4, strategy=s).by_fold(dealt, names).select("combo", "cell", "fold", "cases", "controls").collect())) for s in ("sql", "gram"))
    assert one == two and sum(r[3] + r[4] for r in one) == 90 * 10
    with pytest.raises(ValueError):
        MDR(3, 4, strategy="gram").by_fold(dealt, names)
    with pytest.raises(ValueError):
        MDR(2, 4, strategy="block").by_fold(dealt, names)


def test_mdr_three_way(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(120):
        x = [int(v) for v in rng.integers(0, 3, 4)]
        rows.append((*x, int((x[0] == 1) != (x[2] == 1))))
    model = MDR(2, 4).fit(genes(spark, rows, 4), "y", ["f0", "f1", "f2", "f3"], "id")
    assert model.best_interaction == (0, 2) and model.best_cvc == 4


@pytest.mark.parametrize("key", ["id", "cast(id as string)", "id * id * 1000", "if(id < 30, 0, id)"])
def test_folds_go_by_class_in_order_of_any_id(spark, key):
    df = genes(spark, F8 * 5).selectExpr("id as place", f"{key} as id", "f0", "f1", "y").repartition(4)
    got = sorted(((r["y"], r["id"], r["fold"]) for r in with_folds(df, "y", "id", 3).collect()), key=lambda r: r[:2])
    for y in (0, 1):
        mine = [r for r in got if r[0] == y]
        by_id = {}
        for _, i, fold in mine:
            by_id.setdefault(i, []).append(fold)
        dealt = [k % 3 for k in range(len(mine))]
        at = 0
        for i in sorted(by_id):
            assert sorted(by_id[i]) == sorted(dealt[at : at + len(by_id[i])])
            at += len(by_id[i])


def test_mdr_beside_columns_of_its_own_names(spark):
    df = genes(spark, F8).selectExpr("id", "f0", "f1", "y as risk", "'a' as y", "1 as fold", "2 as _range", "3 as _place", "4 as g0", "5 as cell")
    search = MDR(2, 2)
    model = search.fit(df, "risk", ["f0", "f1"], "id")
    assert model.best_interaction == (0, 1) and search.score(df, "risk") == 1.0
    assert search.transform(df).columns == [*df.columns, "mdr"]
    dealt = with_folds(df, "risk", "id", 2)
    assert dealt.columns == [c for c in df.columns if c != "fold"] + ["fold"] and dealt.first()["_range"] == 2
    assert search.get_params() == {"k": 2, "cv": 2, "verbose": False, "strategy": "auto"} and search.clone() == MDR(2, 2) and search.clone().model is None
    assert search.set_params(k=1).k == 1
    with pytest.raises(ValueError):
        search.set_params(folds=3)
    assert MDR(2, 2).fit_transform(df, "risk", ["f0", "f1"], "id").where("mdr = risk").count() == 8


def test_mdr_refusals(spark):
    df = genes(spark, F8)
    for bad, search in [
        (genes(spark, [(0, 0, 0), (0, 0, 2)]), MDR(2, 2)),
        (genes(spark, [(0, 3, 0), (0, 0, 1)]), MDR(2, 2)),
        (genes(spark, [(0, -1, 0), (0, 0, 1)]), MDR(2, 2)),
        (df, MDR(7, 2)),
        (df, MDR(3, 2)),
        (df, MDR(2, 10)),
        (df, MDR(2, 1)),
    ]:
        with pytest.raises(ValueError):
            search.fit(bad, "y", ["f0", "f1"], "id")
    with pytest.warns(UserWarning):
        MDR(2, 3).fit(df, "y", ["f0", "f1"], "id")
    with pytest.raises(NotFittedError):
        MDR().predict(df)


def test_pipeline_stages(spark):
    rows = genes(spark, F8)
    out = Pipeline(stages=[SelectorStage(MRMR(1), "y", ["f0", "f1"])]).fit(rows).transform(rows)
    assert out.columns in (["id", "y", "f0"], ["id", "y", "f1"])
    made = Pipeline(stages=[InteractionStage(MDR(2, 2), "y", ["f0", "f1"], "id")]).fit(rows)
    assert [r["mdr"] for r in made.transform(rows).orderBy("id").collect()] == [r[-1] for r in F8]


def test_stages_are_saved_and_loaded(spark, tmp_path):
    rows = genes(spark, F8)
    stages = [InteractionStage(MDR(2, 2), "y", ["f0", "f1"], "id", outputCol="risk"), SelectorStage(TuRF(SURF(discrete_limit=3), 1, 0.5), "y", ["f0", "f1"], "id")]
    pipeline = Pipeline(stages=stages)
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    again = Pipeline.load(str(tmp_path / "p"))
    assert again.getStages()[1].getOperator() == TuRF(SURF(discrete_limit=3), 1, 0.5) and again.getStages()[0].getOperator() == MDR(2, 2)
    model = pipeline.fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    one, two, three = (sorted(map(tuple, m.transform(rows).collect())) for m in (model, loaded, again.fit(rows)))
    assert one == two == three and loaded.stages[1].getSupport() == model.stages[1].getSupport() and "risk" in loaded.transform(rows).columns


def test_settings_go_into_a_grid(spark):
    rng = np.random.default_rng(0)
    rows = genes(spark, [(int(a), int(b), int(a)) for a, b in rng.integers(0, 2, (40, 2))])
    stage = SelectorStage(ReliefF(1, n_neighbors=1), "y", ["f0", "f1"], "id")
    grid = ParamGridBuilder().addGrid(stage.settings, [{"n_features_to_select": 1, "n_neighbors": k} for k in (1, 4)] + [{"n_features_to_select": 2}]).build()
    models = stage.fit(rows, grid)
    assert [m.getFeatureNamesOut()[0] for m in models] == ["f0"] * 3 and [len(m.getFeatureNamesOut()) for m in models] == [1, 1, 2]
    arrays = rows.selectExpr("id", "y", "array(f0, f1) as x")
    found = SelectorStage(ReliefF(1, n_neighbors=2), "y", "x", "id").fit(arrays)
    assert found.transform(arrays).columns == ["id", "y", "x"] and found.getFeatureNamesOut() == ["x[0]"]


def test_streams(spark, tmp_path):
    rows = genes(spark, F8)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    names, got = ["f0", "f1"], []

    def stream():
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    query = stream_chi2(stream(), "y", names, lambda scores, _: got.append([(r["feature_idx"], r["chi2"]) for r in scores.orderBy("feature_idx").collect()]), str(tmp_path / "c1"))
    query.processAllAvailable()
    query.stop()
    whole = [(r["feature_idx"], r["chi2"]) for r in chi2(rows, "y", names).orderBy("feature_idx").collect()]
    assert [k for k, _ in got[-1]] == [0, 1] and [v for _, v in got[-1]] == pytest.approx([v for _, v in whole])
    query = stream_relevance(stream(), "y", names, lambda found, _: got.append({r["pair"]: r["mi"] for r in found.collect()}), str(tmp_path / "c2"))
    query.processAllAvailable()
    query.stop()
    assert set(got[-1]) == {0, 1}


@pytest.mark.parametrize("name", ["chi2_lineitem", "chi2_events", "mi_relevance", "mrmr_mid", "cfs_subset", "surf_sql", "multisurf_star", "relieff_k3", "relieff_rounds", "multisurf_star_rounds", "mdr_cv_winner", "mdr_lut", "mdr_predict", "project_cfs"])
def test_catalogue_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "customer", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(catalogue.SQL[name])
    names = [c[0] for c in found.description]
    expected = sorted(found.fetchall(), key=str)
    got = sorted((tuple(r[c] for c in names) for r in catalogue.QUERIES[name](spark, DATA).collect()), key=str)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, abs=1e-6)


def test_every_query_is_wired():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
