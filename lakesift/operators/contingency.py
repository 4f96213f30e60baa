"""Cell counts of pairs of columns, and the matrices that come from them.

Strategy sql counts the cells of each pair in each task and sums them by cell; what moves is one row for each cell of a task, and
values become strings only there. Strategy gram turns each batch into one-hot
columns and adds up their products, which gives all pairs at once; it suits many columns of few values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.dataset import FeatureFrame
from lakesift.functions.information import mutual_information, symmetrical_uncertainty

MOST_STATES = 5000
#: Cells that a task holds at most before it hands them on.
HELD_CELLS = 2_000_000
WIDE = 1 << 31


class _Codes:
    """Numbers the values of a column as they are met in a task; null has a number too."""

    def __init__(self) -> None:
        self.numbers: dict = {}
        self.names: list[str | None] = []

    def of(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode(null_encoding="encode")
        values = coded.dictionary
        spots = np.empty(len(values), np.int64)
        for k, (value, name) in enumerate(zip(values.to_pylist(), values.cast(pa.string()).to_pylist())):
            if value not in self.numbers:
                self.numbers[value] = len(self.names)
                self.names.append(name)
            spots[k] = self.numbers[value]
        return spots[coded.indices.to_numpy()]


def cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, x, y, n): pair is the place in the list; x and y are the values as strings."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    index = [(columns.index(a), columns.index(b)) for a, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, size = [_Codes() for _ in columns], [[] for _ in index], 0

        def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)

        def given() -> Iterator[pa.RecordBatch]:
            for pair, found in enumerate(held):
                if found:
                    (a, b), (keys, n) = index[pair], merged(found)
                    x, y = (pa.array(codes[c].names, pa.string()).take(pa.array(k)) for c, k in ((a, keys // WIDE), (b, keys % WIDE)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), pair, np.int32)), x, y, pa.array(n)], names=["pair", "x", "y", "n"])

        for batch in batches:
            spots = [c.of(column) for c, column in zip(codes, batch.columns)]
            for pair, (a, b) in enumerate(index):
                keys, n = np.unique(spots[a] * WIDE + spots[b], return_counts=True)
                held[pair].append((keys, n))
                size += len(keys)
            if size > HELD_CELLS:
                held = [[merged(found)] if found else [] for found in held]
                size = sum(len(k) for found in held for k, _ in found)
                if size > HELD_CELLS // 2:
                    yield from given()
                    codes, held, size = [_Codes() for _ in columns], [[] for _ in index], 0
        yield from given()

    counted = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(run, "pair int, x string, y string, n long")
    return counted.groupBy("pair", "x", "y").agg(F.sum("n").alias("n"))


def gram_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, x, y, n) for all pairs of columns a < b (positions), from products of one-hot matrices, which grow as a task meets values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [_Codes() for _ in columns]
        states: list[tuple[int, int]] = []
        place: list[list[int]] = [[] for _ in columns]
        total = np.zeros((0, 0))
        for batch in batches:
            spots = [c.of(column) for c, column in zip(codes, batch.columns)]
            for k, c in enumerate(codes):
                for number in range(len(place[k]), len(c.names)):
                    place[k].append(len(states))
                    states.append((k, number))
            if len(states) > MOST_STATES:
                raise ValueError(f"more than {MOST_STATES} different values: use strategy='sql'")
            grown = np.zeros((len(states), len(states)))
            grown[: len(total), : len(total)] = total
            total = grown
            for at in range(0, batch.num_rows, 4096):
                rows = min(4096, batch.num_rows - at)
                hot = np.zeros((rows, len(states)), np.float32)
                for k, spot in enumerate(spots):
                    hot[np.arange(rows), np.array(place[k], np.int64)[spot[at : at + rows]]] = 1
                total += hot.T @ hot
        i, j = np.nonzero(total)
        column, name = np.array([k for k, _ in states], np.int32), pa.array([codes[k].names[n] for k, n in states], pa.string())
        keep = column[i] < column[j] if len(states) else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        if len(i):
            parts = [pa.array(column[i]), pa.array(column[j]), name.take(pa.array(i)), name.take(pa.array(j)), pa.array(total[i, j].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(parts, names=["a", "b", "x", "y", "n"])

    counted = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(run, "a int, b int, x string, y string, n long")
    return counted.groupBy("a", "b", "x", "y").agg(F.sum("n").alias("n"))


def _discrete(frame: FeatureFrame, columns: Sequence[str], non_negative: bool) -> None:
    for c in columns:
        if not frame.is_integral(c):
            raise ValueError(f"{c} must be of an integer type")
    if non_negative and columns:
        low = frame.df.agg(F.least(*[F.min(F.col(c).cast("long")) for c in columns], F.lit(0))).first()[0]
        if low is not None and low < 0:
            raise ValueError("values must not be negative")


def mi_pair(df: DataFrame, x1: str, x2: str, unit: str = "bit") -> DataFrame:
    """(mi): mutual information of two columns of non-negative integers."""
    frame = FeatureFrame.of(df, x2, [x1])
    _discrete(frame, [x1, x2], True)
    return mutual_information(cells(df, [(x1, x2)]), unit).select("mi")


def _matrices(df: DataFrame, label_col: str, feature_cols: Sequence[str], strategy: str, measure: Callable[[DataFrame], DataFrame], value: str) -> tuple[DataFrame, DataFrame]:
    """(feature_idx, feature, value) with the label, and (f1, f2, value) for positions f1 < f2."""
    if strategy not in ("sql", "gram"):
        raise ValueError("strategy must be 'sql' or 'gram'")
    p, names = len(feature_cols), df.sparkSession.createDataFrame(list(enumerate(feature_cols)), "feature_idx int, feature string")

    def named(found: DataFrame) -> DataFrame:
        return found.join(F.broadcast(names), "feature_idx").select("feature_idx", "feature", value)

    if strategy == "gram":
        counted = gram_cells(df, [*feature_cols, label_col]).withColumn("pair", F.col("a") * (p + 1) + F.col("b"))
        found = measure(counted).select(F.floor(F.col("pair") / (p + 1)).cast("int").alias("f1"), (F.col("pair") % (p + 1)).cast("int").alias("f2"), value)
        return named(found.where(F.col("f2") == p).select(F.col("f1").alias("feature_idx"), value)), found.where(F.col("f2") < p)
    relevance = measure(cells(df, [(c, label_col) for c in feature_cols])).select(F.col("pair").alias("feature_idx"), value)
    index = [(i, j) for i in range(p) for j in range(i + 1, p)]
    if not index:
        return named(relevance), df.sparkSession.createDataFrame([], f"f1 int, f2 int, {value} double")
    where = F.broadcast(df.sparkSession.createDataFrame([(k, i, j) for k, (i, j) in enumerate(index)], "pair int, f1 int, f2 int"))
    return named(relevance), measure(cells(df, [(feature_cols[i], feature_cols[j]) for i, j in index])).join(where, "pair").select("f1", "f2", value)


def mi_matrices(df: DataFrame, label_col: str, feature_cols: Sequence[str], unit: str = "bit", strategy: str = "sql") -> tuple[DataFrame, DataFrame]:
    """Relevance (feature_idx, feature, mi) and redundancy (f1, f2, mi) for positions f1 < f2; the matrix is symmetric and 0 on its diagonal."""
    _discrete(FeatureFrame.of(df, label_col, feature_cols), [*feature_cols, label_col], True)
    return _matrices(df, label_col, feature_cols, strategy, lambda counted: mutual_information(counted, unit), "mi")


def su_matrices(df: DataFrame, label_col: str, feature_cols: Sequence[str], strategy: str = "sql") -> tuple[DataFrame, DataFrame]:
    """Symmetrical uncertainty with the label (feature_idx, feature, su) and between features (f1, f2, su)."""
    FeatureFrame.of(df, label_col, feature_cols)
    return _matrices(df, label_col, feature_cols, strategy, symmetrical_uncertainty, "su")
