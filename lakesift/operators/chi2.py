"""Chi-squared of the sums of non-negative features by class."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.checkpoints import cut
from lakesift.dataset import MOST_CLASSES, FeatureFrame, matrix
from lakesift.functions.stats import chi2_sf

LEAST_EXPECTED = 1e-12


def class_sums(frame: FeatureFrame) -> DataFrame:
    """(label, n, s0, s1, ...): rows and feature sums of each class, in one aggregation."""
    sums = [F.sum(F.col(c).cast("double")).alias(f"s{k}") for k, c in enumerate(frame.feature_cols)]
    return frame.df.groupBy(F.col(frame.label_col).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)


def _scored(long: DataFrame, n: float, n_classes: int) -> DataFrame:
    """(feature_idx, chi2, p_value); long: (feature_idx, n, observed) for each class, n: all rows."""
    totals = long.groupBy("feature_idx").agg(F.sum("observed").alias("total"))
    expected = F.col("n") * F.col("total") / F.lit(float(n))
    cells = long.join(totals, "feature_idx").withColumn("expected", expected)
    term = F.when(F.col("expected") > LEAST_EXPECTED, (F.col("observed") - F.col("expected")) ** 2 / F.when(F.col("expected") > LEAST_EXPECTED, F.col("expected")).otherwise(1.0))
    found = cells.groupBy("feature_idx").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("chi2"))
    if n_classes < 2:
        found = found.withColumn("chi2", F.lit(0.0))
    return found.withColumn("p_value", chi2_sf(F.col("chi2"), n_classes - 1))


def _named(found: DataFrame, names: Sequence[str]) -> DataFrame:
    listed = found.sparkSession.createDataFrame(list(enumerate(names)), "feature_idx int, feature string")
    return found.join(F.broadcast(listed), "feature_idx").select("feature_idx", "feature", "chi2", "p_value")


def chi2_of_sums(sums: DataFrame, names: Sequence[str], n_classes: int, n: float | None = None) -> DataFrame:
    """(feature_idx, feature, chi2, p_value) from the rows and sums of each class."""
    if n is None:
        n = sums.agg(F.sum("n")).first()[0] or 0.0
    cells = [F.struct(F.lit(k).alias("feature_idx"), F.col(f"s{k}").alias("observed")) for k in range(len(names))]
    return _named(_scored(sums.select("n", F.inline(F.array(*cells))), n, n_classes), names)


def _check(rows: int, n_classes: int, label_col: str, unknown: bool, infinite: bool, no_label: bool, negative: bool) -> None:
    if unknown:
        raise ValueError("Input X contains NaN")
    if infinite:
        raise ValueError("Input X contains infinity")
    if no_label:
        raise ValueError("Input y contains NaN")
    if not rows or n_classes > MOST_CLASSES:
        raise ValueError("Found 0 rows; at least 1 are needed" if not rows else f"more than {MOST_CLASSES} classes: is {label_col} a label?")
    if negative:
        raise ValueError("Input matrix X must contain non-negative values.")


NAN, INFINITE, NEGATIVE, NO_LABEL, NULL_ROW, OTHER_LENGTH = (1 << k for k in range(6))


def _array_sums(p: int):
    """A function for mapInArrow: (label, values) to a task's sums, a row for each class and feature, and one with what is wrong with its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        faults = 0
        for batch in batches:
            labels, lists = batch.column(0), batch.column(1)
            faults |= NO_LABEL * (labels.null_count > 0) | NULL_ROW * (lists.null_count > 0)
            right = np.asarray(lists.value_lengths().fill_null(-1)) == p
            faults |= OTHER_LENGTH * bool((~right & np.asarray(lists.is_valid())).any())
            if not right.all():
                labels, lists = labels.filter(pa.array(right)), lists.filter(pa.array(right))
            x = matrix(lists)
            if not len(x):
                continue
            low, high = x.min(), x.max()
            faults |= NAN * bool(np.isnan(low)) | INFINITE * bool(np.isinf(x).any() if not np.isfinite([low, high]).all() else False) | NEGATIVE * bool(low < 0)
            coded = labels.dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy()
            for k, label in enumerate(coded.dictionary.to_pylist()):
                mine = x[codes == k]
                sums = held.setdefault(label, [0, np.zeros(p)])
                sums[0], sums[1] = sums[0] + len(mine), sums[1] + mine.sum(axis=0)
        names, kinds = ["label", "feature_idx", "n", "observed", "faults"], [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int32()]
        for label, (n, sums) in held.items():
            columns = [[label] * p, np.arange(p), np.full(p, n), sums, np.zeros(p, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[None], [-1], [0], [0.0], [faults]], kinds)], names=names)

    return run


def _array_chi2(frame: FeatureFrame) -> DataFrame:
    """The same over the components of an array column: one pass gives sums and checks, a row for each task, class and feature is shuffled."""
    rows = frame.df.select(F.col(frame.label_col).cast("string").alias("label"), frame.values().alias("x"))
    parts = rows.mapInArrow(_array_sums(frame.n_features), "label string, feature_idx int, n long, observed double, faults int")
    sums = parts.groupBy("label", "feature_idx").agg(F.sum("n").cast("double").alias("n"), F.sum("observed").alias("observed"), F.bit_or("faults").alias("faults"))
    sums = cut(sums)
    faults = sums.agg(F.bit_or("faults")).first()[0] or 0
    frame.check_lengths(faults & NULL_ROW, faults & OTHER_LENGTH)
    classes = sums.where("feature_idx = 0").select("n").limit(MOST_CLASSES + 1).collect()
    _check(len(classes), len(classes), frame.label_col, bool(faults & NAN), bool(faults & INFINITE), bool(faults & NO_LABEL), bool(faults & NEGATIVE))
    return _named(_scored(sums.where("feature_idx >= 0").select("feature_idx", "n", "observed"), sum(r[0] for r in classes), len(classes)), frame.feature_cols)


def chi2(df: DataFrame, label_col: str, feature_cols: Sequence[str] | str | None = None) -> DataFrame:
    """(feature_idx, feature, chi2, p_value). A feature that is 0 everywhere has chi2 0 and p 1; so has every feature of a single class.

    One pass gives each class's rows and sums and all checks; what follows works on a row for each class. feature_cols may be one array column.
    """
    frame = FeatureFrame.of(df, label_col, feature_cols)
    if frame.array_col is not None:
        return _array_chi2(frame)
    found, p = [F.count(F.lit(1)).cast("double")], frame.n_features
    for c in frame.feature_cols:
        x = F.col(c).cast("double")
        found += [F.sum(x), F.min(x), F.count_if(x.isNull() | F.isnan(x)), F.count_if(F.abs(x) == float("inf"))]
    rows = frame.df.groupBy(label_col).agg(*[e.alias(f"a{k}") for k, e in enumerate(found)]).limit(MOST_CLASSES + 1).collect()
    seen = [[r[4 * k + c] for r in rows for k in range(p)] for c in (3, 4, 5)]
    _check(len(rows), len(rows), label_col, any(seen[1]), any(seen[2]), any(r[0] is None for r in rows), any(x is not None and x < 0 for x in seen[0]))
    schema = ", ".join(["n double", *[f"s{k} double" for k in range(p)]])
    sums = df.sparkSession.createDataFrame([(r[1], *[r[4 * k + 2] for k in range(p)]) for r in rows], schema)
    return chi2_of_sums(sums, frame.feature_cols, len(rows), sum(r[1] for r in rows))
