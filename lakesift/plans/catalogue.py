"""The queries over the standard tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.dataset import FeatureFrame, spread_array
from lakesift.functions.binning import bin_by_edges, binned, kmeans_edges, quantile_edges, uniform_bin
from lakesift.functions.information import symmetrical_uncertainty
from lakesift.operators.cfs import CFS
from lakesift.operators.chi2 import chi2
from lakesift.operators.contingency import cells, mi_matrices, mi_pair
from lakesift.operators.mdr import MDR, balanced_accuracy, cell_counts, with_folds
from lakesift.operators.mrmr import MRMR
from lakesift.operators.relief import SURF, MultiSURF, ReliefF
from lakesift.operators.turf import TuRF
from lakesift.plans import sql
from lakesift.sources import table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
EVENT = ["value", "hour", "k"]
CODES = ["linenumber", "discount", "tax", "quantity"]
PLANTED = ["q", "qn", "linenumber", "discount"]
TWO = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]
CUSTOMER = ["c_acctbal", "c_nationkey"]
DIMS = [f"e{k}" for k in range(64)]
#: How many features the wide queries make of a vector's components.
WIDE = 20_000
#: TuRF over the embeddings: how many stay, and the share that goes in a round.
TURF = (8, 0.5)
#: So small a block that the rounds of blocks are many.
SMALL_BLOCK = 1 << 14
GENES = ["g0", "g1", "g2", "g3"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select("event_type", "value", F.hour("ts").cast("double").alias("hour"), k.alias("k"))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("linenumber"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.col("l_quantity").cast("int").alias("quantity"),
        flag.alias("flag"),
    )


def _planted(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("y"),
        F.col("l_quantity").cast("double").alias("q"),
        (F.col("l_quantity") + 3 * F.col("l_linenumber")).alias("qn"),
        F.col("l_linenumber").alias("linenumber"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount"),
    )
    return binned(lines, ["q", "qn"], 10)


def _two(spark: SparkSession, d: str) -> DataFrame:
    label = 2 * (F.col("l_quantity") > 25).cast("int") + (F.col("l_linenumber") > 4).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", label.alias("y"), *TWO)


def _dims(spark: SparkSession, d: str) -> DataFrame:
    return spread_array(table(spark, d, "embeddings"), "embedding", len(DIMS), "e").select("vec_id", "label", *DIMS)


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """WIDE features in one array column: a component's size, times how often the components have been gone through."""
    x = F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda k: F.abs(F.get("embedding", (k % 64).cast("int")).cast("double")) * (1 + F.floor(k / 64)))
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") % 3).alias("y"), x.alias("x"))


def _genes(spark: SparkSession, d: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("int") % 3
    y = ((F.col("l_linenumber") % 3 == 1) & (quantity == 1)).cast("int")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_linenumber") % 3).alias("g0"), quantity.alias("g1"),
        (F.round(F.col("l_discount") * 100).cast("int") % 3).alias("g2"), (F.round(F.col("l_tax") * 100).cast("int") % 3).alias("g3"), y.alias("y"),
    )


def chi2_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return _chi2_rounded(chi2(table(spark, d, "lineitem"), "l_returnflag", LINE))


def chi2_events(spark: SparkSession, d: str) -> DataFrame:
    return _chi2_rounded(chi2(_events(spark, d), "event_type", EVENT))


def chi2_topk(spark: SparkSession, d: str) -> DataFrame:
    return chi2_lineitem(spark, d).orderBy(F.col("chi2").desc(), "feature_idx").limit(2)


def _chi2_rounded(found: DataFrame) -> DataFrame:
    return found.select("feature_idx", "feature", F.round("chi2", 4).alias("chi2"), F.round("p_value", 6).alias("p_value"))


def chi2_wide(spark: SparkSession, d: str) -> DataFrame:
    return chi2(_wide(spark, d), "y", "x").select("feature_idx", F.round("chi2", 4).alias("chi2"), F.round("p_value", 6).alias("p_value"))


def ranges_wide(spark: SparkSession, d: str) -> DataFrame:
    return FeatureFrame.of(_wide(spark, d), "y", "x").ranges(10)


def profile_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return FeatureFrame.of(table(spark, d, "lineitem"), "l_returnflag", LINE).profile(10)


def _relevance(spark: SparkSession, d: str, unit: str, strategy: str = "sql") -> DataFrame:
    found = mi_matrices(_codes(spark, d), "flag", CODES, unit, strategy)[0]
    return found.select("feature_idx", "feature", F.round("mi", 9).alias("mi"))


def mi_pair_query(spark: SparkSession, d: str) -> DataFrame:
    return mi_pair(_codes(spark, d), "linenumber", "flag").select(F.round("mi", 9).alias("mi"))


def mi_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _relevance(spark, d, "bit")


def mi_nat(spark: SparkSession, d: str) -> DataFrame:
    return _relevance(spark, d, "nat")


def mi_gram(spark: SparkSession, d: str) -> DataFrame:
    return _relevance(spark, d, "bit", "gram")


def mi_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return mi_matrices(_codes(spark, d), "flag", CODES)[1].select("f1", "f2", F.round("mi", 9).alias("mi"))


def su_relevance(spark: SparkSession, d: str) -> DataFrame:
    found = symmetrical_uncertainty(cells(_planted(spark, d), [(c, "y") for c in PLANTED]))
    return found.select(F.col("pair").alias("feature_idx"), F.round("su", 9).alias("su"), F.round("hx", 9).alias("hx"), F.round("hy", 9).alias("hy"))


def su_matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs = [(i, j) for i in range(len(PLANTED)) for j in range(i + 1, len(PLANTED))]
    found = symmetrical_uncertainty(cells(_planted(spark, d), [(PLANTED[i], PLANTED[j]) for i, j in pairs]))
    one, two = (F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair") + 1) for k in (0, 1))
    return found.select(one.alias("f1"), two.alias("f2"), F.round("su", 9).alias("su"))


def bin_uniform(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_extendedprice")
    low, high = lines.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return lines.groupBy(uniform_bin(F.col("l_extendedprice"), F.lit(low), F.lit(high), 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bin_quantile(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_acctbal")
    edges = quantile_edges(people, ["c_acctbal"], 10)["c_acctbal"]
    return people.groupBy(bin_by_edges(F.col("c_acctbal"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bin_kmeans(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_acctbal")
    edges = kmeans_edges(people, ["c_acctbal"], 5)["c_acctbal"]
    return people.groupBy(bin_by_edges(F.col("c_acctbal"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _mrmr(spark: SparkSession, d: str, method: str) -> DataFrame:
    model = MRMR(2, method).fit(_planted(spark, d), "y", PLANTED)
    rows = [(s, k, PLANTED[k], v) for s, (k, v) in enumerate(zip(model.top_features, model.details["step_scores"]), 1)]
    return spark.createDataFrame(rows, "step int, feature_idx int, feature string, score double").withColumn("score", F.round("score", 6))


def mrmr_mid(spark: SparkSession, d: str) -> DataFrame:
    return _mrmr(spark, d, "MID")


def mrmr_miq(spark: SparkSession, d: str) -> DataFrame:
    return _mrmr(spark, d, "MIQ")


def cfs_subset(spark: SparkSession, d: str) -> DataFrame:
    model = CFS().fit(_two(spark, d), "y", TWO)
    rows = [(k, TWO[k], model.details["merit"]) for k in model.top_features]
    return spark.createDataFrame(rows, "feature_idx int, feature string, merit double").withColumn("merit", F.round("merit", 6))


def project_cfs(spark: SparkSession, d: str) -> DataFrame:
    rows = _two(spark, d)
    return CFS().fit(rows, "y", TWO).transform(rows, keep=["l_orderkey"], feature_cols=TWO)


def _relief_scores(spark: SparkSession, scorer, rows: DataFrame, label: str, features: list[str], key: str) -> DataFrame:
    model = scorer.fit(rows, label, features, key)
    return model.scores(spark).select("feature_idx", "feature", "is_discrete", F.round(F.col("score") + 0.0, 6).alias("score"))


def _customer(scorer):
    return lambda spark, d: _relief_scores(spark, scorer(), table(spark, d, "customer"), "c_mktsegment", CUSTOMER, "c_custkey")


def _embedding(scorer):
    return lambda spark, d: _relief_scores(spark, scorer(), _dims(spark, d), "label", DIMS, "vec_id")


def turf_multisurf(spark: SparkSession, d: str) -> DataFrame:
    model = TuRF(MultiSURF(), *TURF).fit(_dims(spark, d), "label", DIMS, "vec_id")
    rows = [(k, c, float(s), k in model.top_features) for k, (c, s) in enumerate(zip(DIMS, model.feature_importances))]
    return spark.createDataFrame(rows, "feature_idx int, feature string, score double, survives boolean").withColumn("score", F.round("score", 6))


def mdr_balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _genes(spark, d)
    n_case, n_control = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    return balanced_accuracy(cell_counts(rows, GENES, 2), F.lit(n_case), F.lit(n_control)).select("combo", F.round("ba", 9).alias("ba"))


def _numbered_genes(spark: SparkSession, d: str) -> DataFrame:
    """With an id: the row's order by keys, which folds are dealt by."""
    return _genes(spark, d).withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def _dealt_genes(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a fold; what ties in the key is ordered by the genotypes, so that equal rows alone are interchangeable."""
    return with_folds(_numbered_genes(spark, d), "y", "key", 5, GENES)


def mdr_cv_winner(spark: SparkSession, d: str) -> DataFrame:
    search = MDR(2, 5)
    won = search.winners(search.by_fold(_dealt_genes(spark, d), GENES))
    return won.select("fold", "combo", F.round("train_ba", 9).alias("train_ba"), F.round("test_ba", 9).alias("test_ba"))


def _fitted_mdr(spark: SparkSession, d: str):
    rows = _numbered_genes(spark, d)
    return rows, MDR(2, 5).fit(rows, "y", GENES, "key")


def mdr_lut(spark: SparkSession, d: str) -> DataFrame:
    _, model = _fitted_mdr(spark, d)
    rows = [(k, *model.best_interaction, v) for k, v in enumerate(model.lookup_table)]
    return spark.createDataFrame(rows, "cell int, first int, second int, high_risk int")


def mdr_predict(spark: SparkSession, d: str) -> DataFrame:
    rows, model = _fitted_mdr(spark, d)
    return model.predict(rows).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "chi2_lineitem": chi2_lineitem,
    "chi2_events": chi2_events,
    "chi2_topk": chi2_topk,
    "chi2_wide": chi2_wide,
    "ranges_wide": ranges_wide,
    "profile_lineitem": profile_lineitem,
    "mi_pair": mi_pair_query,
    "mi_relevance": mi_relevance,
    "mi_redundancy": mi_redundancy,
    "mi_nat": mi_nat,
    "mi_gram": mi_gram,
    "su_relevance": su_relevance,
    "su_matrix": su_matrix,
    "bin_uniform": bin_uniform,
    "bin_quantile": bin_quantile,
    "bin_kmeans": bin_kmeans,
    "mrmr_mid": mrmr_mid,
    "mrmr_miq": mrmr_miq,
    "cfs_subset": cfs_subset,
    "project_cfs": project_cfs,
    "surf": _customer(SURF),
    "surf_star": _customer(lambda: SURF(use_star=True)),
    "surf_sql": _customer(lambda: SURF(strategy="sql")),
    "surf_star_sql": _customer(lambda: SURF(use_star=True, strategy="sql")),
    "surf_rounds": _customer(lambda: SURF(block_bytes=SMALL_BLOCK)),
    "multisurf": _customer(MultiSURF),
    "multisurf_star": _customer(lambda: MultiSURF(use_star=True)),
    "multisurf_sql": _customer(lambda: MultiSURF(strategy="sql")),
    "multisurf_star_sql": _customer(lambda: MultiSURF(use_star=True, strategy="sql")),
    "multisurf_star_rounds": _customer(lambda: MultiSURF(use_star=True, block_bytes=SMALL_BLOCK)),
    "relieff_k3": _customer(ReliefF),
    "relieff_rounds": _customer(lambda: ReliefF(block_bytes=SMALL_BLOCK)),
    "relieff_sql": _customer(lambda: ReliefF(strategy="sql")),
    "relieff_embeddings": _embedding(lambda: ReliefF(n_neighbors=5)),
    "multisurf_embeddings": _embedding(MultiSURF),
    "turf_multisurf": turf_multisurf,
    "mdr_balanced_accuracy": mdr_balanced_accuracy,
    "mdr_cv_winner": mdr_cv_winner,
    "mdr_lut": mdr_lut,
    "mdr_predict": mdr_predict,
}
_CUSTOMER_ROWS = ("SELECT c_custkey AS id, c_mktsegment AS y, c_acctbal::DOUBLE AS x0, c_nationkey::DOUBLE AS x1 FROM customer", CUSTOMER)
_DIM_ROWS = ("SELECT vec_id AS id, label AS y, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS x{k}" for k in range(len(DIMS))) + " FROM embeddings", DIMS)
SQL = {
    "chi2_lineitem": sql.chi2("lineitem", "l_returnflag", LINE, 2),
    "chi2_events": sql.chi2(sql.EVENTS, "event_type", EVENT, 4),
    "chi2_topk": f"SELECT * FROM ({sql.chi2('lineitem', 'l_returnflag', LINE, 2)}) ORDER BY chi2 DESC, feature_idx LIMIT 2",
    "chi2_wide": sql.chi2_wide(WIDE),
    "ranges_wide": sql.ranges_wide(WIDE, 10),
    "profile_lineitem": sql.profile("lineitem", LINE, 10),
    "mi_pair": f"SELECT mi FROM ({sql.relevance(sql.CODES, CODES[:1], 'flag', 'bit')})",
    "mi_relevance": sql.relevance(sql.CODES, CODES, "flag", "bit"),
    "mi_nat": sql.relevance(sql.CODES, CODES, "flag", "nat"),
    "mi_gram": sql.relevance(sql.CODES, CODES, "flag", "bit"),
    "mi_redundancy": sql.redundancy(sql.CODES, CODES),
    "su_relevance": sql.su_relevance(sql.PLANTED, PLANTED, "y"),
    "su_matrix": sql.su_matrix(sql.PLANTED, PLANTED),
    "bin_uniform": sql.BIN_UNIFORM,
    "bin_quantile": sql.BIN_QUANTILE,
    "mrmr_mid": sql.mrmr(sql.PLANTED, PLANTED, "y", "MID"),
    "mrmr_miq": sql.mrmr(sql.PLANTED, PLANTED, "y", "MIQ"),
    "cfs_subset": sql.cfs(sql.TWO, TWO, "y"),
    "project_cfs": sql.projected(sql.cfs(sql.TWO, TWO, "y"), ["l_quantity", "l_linenumber"]),
    **{name: sql.relief("surf", *_CUSTOMER_ROWS) for name in ("surf", "surf_sql", "surf_rounds")},
    **{name: sql.relief("surf", *_CUSTOMER_ROWS, star=True) for name in ("surf_star", "surf_star_sql")},
    **{name: sql.relief("multisurf", *_CUSTOMER_ROWS) for name in ("multisurf", "multisurf_sql")},
    **{name: sql.relief("multisurf", *_CUSTOMER_ROWS, star=True) for name in ("multisurf_star", "multisurf_star_sql", "multisurf_star_rounds")},
    **{name: sql.relief("relieff", *_CUSTOMER_ROWS, k=3) for name in ("relieff_k3", "relieff_sql", "relieff_rounds")},
    "relieff_embeddings": sql.relief("relieff", *_DIM_ROWS, k=5),
    "multisurf_embeddings": sql.relief("multisurf", *_DIM_ROWS),
    "turf_multisurf": sql.turf(*_DIM_ROWS, *TURF, rounds=3),
    "mdr_balanced_accuracy": sql.mdr_accuracy(GENES),
    "mdr_cv_winner": sql.mdr_winners(GENES, 5),
    "mdr_lut": sql.mdr_lut(GENES, 5),
    "mdr_predict": sql.mdr_predict(GENES, 5),
}
