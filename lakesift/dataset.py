"""A labelled table of features: which columns are what, and the checks that every operator starts with.

Features are numeric columns, or the components of one array column (for tables of many thousand features, where a column
each would make plans that Catalyst can't handle). Both are addressed by position.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CLASSES = 10_000


def spread_array(df: DataFrame, column: str, n: int, prefix: str = "f") -> DataFrame:
    """df with the first n components of an array column as the columns prefix0, prefix1, ..."""
    return df.withColumns({f"{prefix}{k}": F.get(F.col(column), k).cast("double") for k in range(n)})


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def least_different(seen: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """The least different values of both, or of seen and the first values if those are enough; a copy, as a view would hold on to all of them."""
    for part in (values[:256], values[256:]):
        seen = np.union1d(seen, part)[:most].copy()
        if len(seen) == most:
            break
    return seen


@dataclass(frozen=True)
class FeatureFrame:
    """feature_cols are addressed by position; id_col is needed only where rows are compared with each other.

    array_col: the column whose components the features are; feature_cols are then their names.
    """

    df: DataFrame
    label_col: str
    feature_cols: tuple[str, ...]
    id_col: str | None = None
    array_col: str | None = None

    @classmethod
    def of(cls, df: DataFrame, label_col: str, feature_cols: Sequence[str] | str | None = None, id_col: str | None = None) -> FeatureFrame:
        """feature_cols: names of columns, or the name of one array column."""
        array_col = feature_cols if isinstance(feature_cols, str) else None
        if array_col is not None:
            feature_cols = [array_col]
        elif feature_cols is None:
            feature_cols = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (label_col, id_col)]
        missing = [c for c in [*feature_cols, label_col, *([id_col] if id_col else [])] if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        if array_col is not None:
            if not isinstance(df.schema[array_col].dataType, T.ArrayType):
                raise ValueError(f"{array_col} must be an array column, or give a list of columns")
            # The length of one row; whoever reads all rows checks that they have it.
            one = df.where(F.col(array_col).isNotNull()).select(F.size(array_col)).first()
            if one is None and df.isEmpty():
                raise ValueError("Found 0 rows; at least 1 are needed")
            if one is None:
                raise ValueError("Input X contains NaN")
            feature_cols = [f"{array_col}[{k}]" for k in range(one[0])]
        if not feature_cols:
            raise ValueError("at least one feature is needed")
        return cls(df, label_col, tuple(feature_cols), id_col, array_col)

    @property
    def n_features(self) -> int:
        return len(self.feature_cols)

    def is_integral(self, column: str) -> bool:
        return isinstance(self.df.schema[column].dataType, (T.IntegralType, T.BooleanType))

    def is_continuous(self, column: str) -> bool:
        return isinstance(self.df.schema[column].dataType, (T.FractionalType,))

    def values(self) -> Column:
        """A row's features as array<double>."""
        if self.array_col is not None:
            return F.col(self.array_col).cast("array<double>")
        return F.array(*[F.col(c).cast("double") for c in self.feature_cols])

    def checked(self, least_rows: int = 1) -> int:
        """The number of rows, after one pass that finds missing and non-finite values and labels."""
        if self.array_col is not None:
            values = self.values()
            self.check_lengths(*self.df.agg(F.count_if(values.isNull()), F.count_if(F.size(values) != self.n_features)).first())
            unknown = [F.count_if(F.exists(values, lambda x: x.isNull() | F.isnan(x))).alias("m")]
            infinite = [F.count_if(F.exists(values, lambda x: F.abs(x) == float("inf"))).alias("i")]
        else:
            numeric = [c for c in self.feature_cols if isinstance(self.df.schema[c].dataType, T.NumericType)]
            unknown = [F.count_if(F.col(c).isNull() | (F.isnan(F.col(c).cast("double")) if c in numeric else F.lit(False))).alias(f"m{k}") for k, c in enumerate(self.feature_cols)]
            infinite = [F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(f"i{k}") for k, c in enumerate(numeric)]
        row = self.df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(self.label_col).isNull()).alias("y"), *unknown, *infinite).first().asDict()
        n, no_label = row.pop("n"), row.pop("y")
        if any(v for k, v in row.items() if k[0] == "m"):
            raise ValueError("Input X contains NaN")
        if any(v for k, v in row.items() if k[0] == "i"):
            raise ValueError("Input X contains infinity")
        if no_label:
            raise ValueError("Input y contains NaN")
        if n < least_rows:
            raise ValueError(f"Found {n} rows; at least {least_rows} are needed")
        return n

    def check_lengths(self, missing: int, other: int) -> None:
        if missing:
            raise ValueError("Input X contains NaN")
        if other:
            raise ValueError(f"{self.array_col} must have one length, not {self.n_features} and another")

    def classes(self) -> list[tuple]:
        """(label, number of rows), in order of the labels."""
        found = self.df.groupBy(self.label_col).count().orderBy(self.label_col).limit(MOST_CLASSES + 1).collect()
        if len(found) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes: is {self.label_col} a label?")
        return [(r[0], r[1]) for r in found]

    def label_code(self, labels: Sequence) -> Column:
        """The label's place among the sorted labels, from 0."""
        return (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(self.label_col)) - 1).cast("int")

    def long(self) -> DataFrame:
        """(label, feature_idx, value): a row for each value."""
        label = F.col(self.label_col).alias("label")
        if self.array_col is not None:
            return self.df.select(label, F.posexplode(self.values()).alias("feature_idx", "value"))
        cells = [F.struct(F.lit(k).alias("feature_idx"), F.col(c).cast("double").alias("value")) for k, c in enumerate(self.feature_cols)]
        return self.df.select(label, F.inline(F.array(*cells)))

    def profile(self, discrete_limit: int = 10) -> DataFrame:
        """(feature_idx, feature, n_distinct, low, high, is_discrete) of each feature.

        Values are made distinct by feature first, so the shuffle carries a row for each different value of a task.
        """
        values = self.long().groupBy("feature_idx", "value").agg(F.count(F.lit(1)).alias("n"))
        out = values.groupBy("feature_idx").agg(F.count(F.lit(1)).alias("n_distinct"), F.min("value").alias("low"), F.max("value").alias("high"))
        names = self.df.sparkSession.createDataFrame(list(enumerate(self.feature_cols)), "feature_idx int, feature string")
        return out.join(F.broadcast(names), "feature_idx").select("feature_idx", "feature", "n_distinct", "low", "high", (F.col("n_distinct") <= discrete_limit).alias("is_discrete"))

    def ranges(self, discrete_limit: int = 10) -> DataFrame:
        """(feature_idx, low, high, is_discrete) of each feature, without a count of its values.

        A task keeps at most discrete_limit + 1 different values of a feature, so the shuffle carries no more than that, however
        many there are.
        """
        most = discrete_limit + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = high = kept = None
            for batch in batches:
                x = matrix(batch.column(0))
                if not len(x):
                    continue
                if low is None:
                    low, high, kept = np.full(x.shape[1], np.inf), np.full(x.shape[1], -np.inf), [np.zeros(0)] * x.shape[1]
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
                for f, seen in enumerate(kept):
                    if len(seen) < most:
                        kept[f] = least_different(seen, x[:, f], most)
                del batch, x
                pa.default_memory_pool().release_unused()
            if low is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low), pa.array(high), pa.array(kept, pa.list_(pa.float64()))], names=["feature_idx", "low", "high", "seen"])

        found = self.df.select(self.values().alias("x")).mapInArrow(run, "feature_idx int, low double, high double, seen array<double>")
        extremes = [F.min("low").alias("low"), F.max("high").alias("high")]
        distinct = F.size(F.array_distinct(F.flatten(F.collect_list("seen"))))
        return found.groupBy("feature_idx").agg(*extremes, (distinct <= discrete_limit).alias("is_discrete"))
