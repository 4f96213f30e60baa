"""Interactions of k genotypes: every combination's cells are called high or low risk, and folds choose the best combination.

Cells are counted once for each combination, fold and class, with sums in each task before the shuffle, and written to the
shared folder; all that follows reads these counts. The counts of
a training set are those of all rows less its fold's. So one pass over the data serves all folds. Combinations
are dealt out in lots, so that a row is never exploded into more than `lot` of them at once; pairs of a moderate number of features
(`gram`) are products of one-hot matrices instead, and no row is exploded.
"""

from __future__ import annotations

import itertools
import logging
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesift.checkpoints import cut
from lakesift.dataset import FeatureFrame
from lakesift.operators.base import NotFittedError, Parameters, check_strategy

MOST_K = 6
LOT = 500
STRATEGIES = ("auto", "sql", "gram")
#: Features up to which a task's one-hot products are small (8 * (3 * features)**2 bytes for each fold and class).
GRAM_FEATURES = 200
SMALL = 1e-9
log = logging.getLogger(__name__)


def cell(columns: Sequence[str]) -> Column:
    """The number of the cell in base 3, the first column's value first."""
    out = F.lit(0)
    for c in columns:
        out = out * 3 + F.col(c).cast("int")
    return out


def with_folds(df: DataFrame, label_col: str, id_col: str, cv: int, ties: Sequence[str] = ()) -> DataFrame:
    """df with fold: rows of each class in order of their id (then of the columns in ties), dealt out in turn.

    Rows are sorted by ranges and numbered within their range, from the number of rows of their class in the ranges before; so no class is sorted in one
    task, whatever the type and spread of the id. A column of the name fold is replaced.
    """
    df = df.drop("fold")
    rows = cut(df.orderBy(id_col, *ties))
    found = rows.groupBy(F.spark_partition_id().alias("part"), F.col(label_col).alias("label")).count().collect()  # a row for each range and class
    before: dict[tuple, int] = {}
    seen: Counter = Counter()
    for part, label, n in sorted(found, key=lambda r: r["part"]):
        before[part, label] = seen[label]
        seen[label] += n
    at = df.columns.index(label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), {}
        for batch in batches:
            labels = batch.column(at).to_pylist()
            folds = []
            for label in labels:
                here = place.get(label)
                if here is None:
                    here = before[part, label]
                folds.append(here % cv)
                place[label] = here + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folds, pa.int32())], names=[*batch.schema.names, "fold"])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("fold", T.IntegerType())]))


def cell_counts(rows: DataFrame, feature_cols: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """(combo, cell, *by, cases, controls) of all combinations; rows: y and the features. combo: place in lexicographic order."""
    combos, out = itertools.combinations(range(len(feature_cols)), k), None
    numbered = enumerate(combos)
    while lot := list(itertools.islice(numbered, LOT)):
        listed = [F.struct(F.lit(n).alias("combo"), cell([feature_cols[f] for f in c]).alias("cell")) for n, c in lot]
        part = rows.select("y", *by, F.inline(F.array(*listed))).groupBy("combo", "cell", *by)
        part = part.agg(F.count_if(F.col("y") == 1).alias("cases"), F.count_if(F.col("y") == 0).alias("controls"))
        out = part if out is None else out.unionAll(part)
    return out


def gram_counts(rows: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """What cell_counts gives by fold for pairs, from products of one-hot matrices: a task adds up one for each fold and class, and hands on their cells."""
    p = len(feature_cols)
    first, second = np.triu_indices(p, 1)  # combinations in lexicographic order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            y, fold, *genes = (c.to_numpy().astype(np.int64) for c in batch.columns)
            group = fold * 2 + y
            for g in np.unique(group).tolist():
                mine = np.flatnonzero(group == g)
                for at in range(0, len(mine), 4096):
                    some = mine[at : at + 4096]
                    hot = np.zeros((len(some), 3 * p), np.float32)
                    for f, gene in enumerate(genes):
                        hot[np.arange(len(some)), 3 * f + gene[some]] = 1
                    total = held.setdefault((g // 2, g % 2), np.zeros((3 * p, 3 * p)))
                    total += hot.T @ hot
        for k in sorted({fold for fold, _ in held}):
            none = np.zeros((3 * p, 3 * p))
            parts = []
            for y in (1, 0):
                cells = held.get((k, y), none).reshape(p, 3, p, 3)[first, :, second, :]
                parts.append(cells.reshape(len(first), 9).astype(np.int64))
            combo, cell = np.nonzero(parts[0] + parts[1])
            columns = [combo.astype(np.int32), cell.astype(np.int32), np.full(len(combo), k, np.int32), parts[0][combo, cell], parts[1][combo, cell]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["combo", "cell", "fold", "cases", "controls"])

    found = rows.select(F.col("y").cast("int"), F.col("fold").cast("int"), *[F.col(c).cast("int") for c in feature_cols])
    found = found.mapInArrow(run, "combo int, cell int, fold int, cases long, controls long")
    return found.groupBy("combo", "cell", "fold").agg(F.sum("cases").alias("cases"), F.sum("controls").alias("controls"))


def balanced_accuracy(counts: DataFrame, n_case: Column, n_control: Column, by: Sequence[str] = ()) -> DataFrame:
    """(combo, *by, ba): cells whose cases stand to controls above the classes' ratio are high; 0 if a class is empty."""
    high = (F.col("controls") == 0) | (F.col("cases") * n_control > F.col("controls") * n_case)
    tp = F.try_divide(F.sum(F.when(high, F.col("cases")).otherwise(0)), F.max(n_case))
    tn = F.try_divide(F.sum(F.when(high, 0).otherwise(F.col("controls"))), F.max(n_control))
    return counts.groupBy("combo", *by).agg(F.coalesce((tp + tn) / 2, F.lit(0.0)).alias("ba"))


@dataclass
class FittedMDR:
    feature_cols: tuple[str, ...]
    best_interaction: tuple[int, ...]
    best_cvc: int
    best_mean_testing_ba: float
    lookup_table: list[int]
    classes: list[int] = field(default_factory=lambda: [0, 1])

    def _risk(self) -> Column:
        table = F.array(*[F.lit(v) for v in self.lookup_table])
        return F.element_at(table, cell([self.feature_cols[f] for f in self.best_interaction]) + 1)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        missing = [c for c in self.feature_cols if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        return df.withColumn(output, self._risk().cast("int"))

    def transform(self, df: DataFrame, output: str = "mdr") -> DataFrame:
        """df with the constructed feature."""
        return self.predict(df, output)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError("the model has classes, no probabilities")

    def score(self, df: DataFrame, label_col: str) -> float:
        """The share of rows whose prediction is their label."""
        return df.agg(F.avg((self._risk() == F.col(label_col)).cast("double"))).first()[0]


@dataclass
class MDR(Parameters):
    k: int = 2
    cv: int = 10
    verbose: bool = False
    strategy: str = "auto"

    model: ClassVar[FittedMDR | None] = None

    def fit(self, df: DataFrame, label_col: str, feature_cols: Sequence[str], id_col: str) -> FittedMDR:
        frame = FeatureFrame.of(df, label_col, feature_cols, id_col)
        frame.checked()
        if not 1 <= self.k <= MOST_K:
            raise ValueError(f"k must be from 1 to {MOST_K}")
        if self.k > frame.n_features:
            raise ValueError("k must not be above the number of features")
        wrong = F.count_if(F.least(*[F.lit(True), *[F.col(c).cast("double").isin(0.0, 1.0, 2.0) for c in feature_cols]]) == F.lit(False))
        if df.agg(wrong).first()[0]:
            raise ValueError("genotypes must be 0, 1 or 2")
        classes = dict(frame.classes())
        if set(classes) != {0, 1}:
            raise ValueError("labels must be 0 and 1")
        if self.cv < 2 or self.cv > max(classes.values()):
            raise ValueError("cv must be at least 2 and not above the rows of every class")
        if self.cv > min(classes.values()):
            warnings.warn("the smallest class has fewer rows than cv", UserWarning, stacklevel=2)
        names = [f"g{f}" for f in range(frame.n_features)]
        rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"), *[F.col(c).alias(g) for c, g in zip(feature_cols, names)])
        counts = self.by_fold(with_folds(rows, "y", "id", self.cv), names)
        winners = {r["fold"]: (r["combo"], r["test_ba"]) for r in self.winners(counts).collect()}
        if self.verbose:
            log.info("MDR: combinations of %d folds: %s", len(winners), winners)
        counted = Counter(c for c, _ in winners.values())
        most = max(counted.values())
        mean = {c: sum(ba for x, ba in winners.values() if x == c) / n for c, n in counted.items()}
        order = list(dict.fromkeys(winners[f][0] for f in sorted(winners)))
        best = min((c for c in order if counted[c] == most), key=lambda c: (-mean[c], order.index(c)))
        picked = next(itertools.islice(itertools.combinations(range(frame.n_features), self.k), best, None))
        table = [0] * 3**self.k
        limit = classes[1] / classes[0]
        chosen = counts.where(F.col("combo") == best).groupBy("cell").agg(F.sum("cases").alias("cases"), F.sum("controls").alias("controls"))
        for r in chosen.collect():
            table[r["cell"]] = int(r["cases"] / (r["controls"] + SMALL) > limit)
        self.model = FittedMDR(frame.feature_cols, picked, counted[best], mean[best], table)
        return self.model

    def by_fold(self, rows: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
        """Counts by combination, cell and fold, written once: combinations times 3**k times folds rows; rows: y, fold and the features."""
        check_strategy(self.strategy, STRATEGIES)
        gram = self.strategy == "gram" or (self.strategy == "auto" and self.k == 2 and len(feature_cols) <= GRAM_FEATURES)
        if gram and self.k != 2:
            raise ValueError("strategy='gram' is for k=2")
        return cut(gram_counts(rows, feature_cols) if gram else cell_counts(rows, feature_cols, self.k, ["fold"]))

    def winners(self, counts: DataFrame) -> DataFrame:
        """(fold, combo, train_ba, test_ba): each fold's best combination on the other folds, the first of equals."""
        one = counts.where(F.col("combo") == 0)  # every combination's cells hold all rows
        sizes = one.groupBy("fold").agg(F.sum("cases").alias("f_case"), F.sum("controls").alias("f_control"))
        every = Window.partitionBy()
        sizes = sizes.withColumns({"n_case": F.sum("f_case").over(every) - F.col("f_case"), "n_control": F.sum("f_control").over(every) - F.col("f_control")})
        cells = counts.groupBy("combo", "cell").agg(F.sum("cases").alias("all_cases"), F.sum("controls").alias("all_controls"))
        full = cells.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(self.cv - 1)))).join(F.broadcast(sizes), "fold")  # cv rows
        seen = full.join(counts, ["combo", "cell", "fold"], "left")
        here, there = F.coalesce("cases", F.lit(0)), F.coalesce("controls", F.lit(0))
        seen = seen.select(
            "combo", "cell", "fold", "f_case", "f_control", "n_case", "n_control",
            here.alias("t_case"), there.alias("t_control"),
            (F.col("all_cases") - here).alias("cases"), (F.col("all_controls") - there).alias("controls"),
        )
        train = balanced_accuracy(seen, F.col("n_case"), F.col("n_control"), ["fold"]).withColumnRenamed("ba", "train_ba")
        low = F.col("cases") / (F.col("controls") + SMALL) <= F.try_divide("n_case", "n_control")

        def share(hits: Column, of: str) -> Column:
            return F.coalesce(F.try_divide(F.sum(hits), F.max(of)), F.lit(0.0))

        test = seen.groupBy("combo", "fold").agg(
            ((share(F.when(low, 0).otherwise(F.col("t_case")), "f_case") + share(F.when(low, F.col("t_control")).otherwise(0), "f_control")) / 2).alias("test_ba")
        )
        best = Window.partitionBy("fold").orderBy(F.col("train_ba").desc(), "combo")
        ranked = train.withColumn("place", F.row_number().over(best)).where(F.col("place") == 1)
        return ranked.join(test, ["combo", "fold"]).select("fold", "combo", "train_ba", "test_ba")

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        if self.model is None:
            raise NotFittedError("this MDR isn't fitted yet")
        return self.model.predict(df, output)

    def transform(self, df: DataFrame, output: str = "mdr") -> DataFrame:
        return self.predict(df, output)

    def fit_transform(self, df: DataFrame, label_col: str, feature_cols: Sequence[str], id_col: str, output: str = "mdr") -> DataFrame:
        return self.fit(df, label_col, feature_cols, id_col).transform(df, output)

    def score(self, df: DataFrame, label_col: str) -> float:
        if self.model is None:
            raise NotFittedError("this MDR isn't fitted yet")
        return self.model.score(df, label_col)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError("the model has classes, no probabilities")
