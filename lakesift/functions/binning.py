"""Bins of continuous columns, numbered from 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.checkpoints import cut

STRATEGIES = ("uniform", "quantile", "kmeans")
MOST_ROUNDS = 300
#: Rows up to which one task may hold all values of a column.
ROWS_AT_ONCE = 1_000_000


def uniform_bin(x: Column, low: Column, high: Column, n_bins: int) -> Column:
    """Bins of equal width; a constant column has the one bin 0."""
    width = F.nullif(high - low, F.lit(0.0))
    return F.when(width.isNull(), 0).otherwise(F.least(F.floor((x - low) * n_bins / width), F.lit(n_bins - 1))).cast("int")


def bin_by_edges(x: Column, edges: list[float]) -> Column:
    """The number of inner edges that are at most x."""
    inner = edges[1:-1]
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in inner]), lambda e: e <= x)).cast("int") if inner else F.lit(0)


def _distinct(edges: list[float]) -> list[float]:
    return [e for k, e in enumerate(edges) if k == 0 or e - edges[k - 1] > 1e-8]


def exact_quantiles(df: DataFrame, column: str, at: list[float]) -> list[float]:
    """Exact quantiles, interpolated between neighbouring ranks, without one task that holds all values.

    Different values are counted and sorted by ranges; the sizes of the ranges tell which of them hold the ranks that are asked for.
    """
    counted = df.select(F.col(column).cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counted.orderBy("x").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    if not total:
        return [None] * len(at)
    ranks = sorted({r for q in at for r in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
    needed = [part for part in starts if any(starts[part] <= r < starts[part] + sizes[part] for r in ranks)]
    offset = F.element_at(F.create_map(*[F.lit(v) for part in needed for v in (part, starts[part])]), F.col("part"))
    running = F.sum("n").over(Window.partitionBy("part").orderBy("x")) + offset
    rows = ranged.where(F.col("part").isin(needed)).withColumn("upto", running)
    wanted = F.filter(F.array(*[F.lit(r) for r in ranks]), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    by_rank = {r["rank"]: r["x"] for r in rows.select("x", F.explode(wanted).alias("rank")).collect()}
    out = []
    for q in at:
        place = q * (total - 1)
        low, high = by_rank[math.floor(place)], by_rank[math.ceil(place)]
        out.append(low + (high - low) * (place - math.floor(place)))
    return out


def quantile_edges(df: DataFrame, columns: list[str], n_bins: int, rows_at_once: int = ROWS_AT_ONCE) -> dict[str, list[float]]:
    """Edges at the exact quantiles, equal ones once. One aggregation for all columns of a small table, ranks by ranges of values for a larger one."""
    at = [k / n_bins for k in range(n_bins + 1)]
    if df.count() > rows_at_once:
        return {c: _distinct(exact_quantiles(df, c, at)) for c in columns}
    row = df.agg(*[F.percentile(F.col(c), F.array(*map(F.lit, at))).alias(f"q{k}") for k, c in enumerate(columns)]).first()
    return {c: _distinct(list(row[k])) for k, c in enumerate(columns)}


def kmeans_edges(df: DataFrame, columns: list[str], n_bins: int) -> dict[str, list[float]]:
    """Edges halfway between the centres of one-dimensional k-means that starts from the middles of uniform bins.

    Each round is one aggregation over all columns that haven't settled, with n_bins rows a column to the driver.
    """
    row = df.agg(*[f(c).cast("double") for c in columns for f in (F.min, F.max)]).first()
    limits = {c: (row[2 * k], row[2 * k + 1]) for k, c in enumerate(columns)}
    centres = {c: sorted({low + (high - low) * (k + 0.5) / n_bins for k in range(n_bins)}) for c, (low, high) in limits.items()}
    open_columns = [c for c in columns if len(centres[c]) > 1]
    for _ in range(MOST_ROUNDS):
        if not open_columns:
            break
        cells = []
        for c in open_columns:
            middles = [(a + b) / 2 for a, b in zip(centres[c], centres[c][1:])]
            cells.append(F.struct(F.lit(c).alias("c"), bin_by_edges(F.col(c), [0.0, *middles, 0.0]).alias("bin"), F.col(c).cast("double").alias("x")))
        found = df.select(F.inline(F.array(*cells))).groupBy("c", "bin").agg(F.avg("x").alias("mean")).collect()
        moved = {c: list(centres[c]) for c in open_columns}
        for r in found:
            moved[r["c"]][r["bin"]] = r["mean"]
        open_columns = [c for c in open_columns if max(abs(a - b) for a, b in zip(moved[c], centres[c])) > 1e-9 * max(1.0, abs(limits[c][1] - limits[c][0]))]
        centres |= {c: sorted(m) for c, m in moved.items()}
    return {c: [limits[c][0], *[(a + b) / 2 for a, b in zip(centres[c], centres[c][1:])], limits[c][1]] for c in columns}


def binned(df: DataFrame, columns: list[str], n_bins: int, strategy: str = "uniform") -> DataFrame:
    """df with these columns replaced by the numbers of their bins."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if not columns:
        return df
    if strategy == "uniform":
        row = df.agg(*[f(c).cast("double") for c in columns for f in (F.min, F.max)]).first()
        return df.withColumns({c: uniform_bin(F.col(c).cast("double"), F.lit(row[2 * k]), F.lit(row[2 * k + 1]), n_bins) for k, c in enumerate(columns)})
    edges = (quantile_edges if strategy == "quantile" else kmeans_edges)(df, columns, n_bins)
    return df.withColumns({c: bin_by_edges(F.col(c).cast("double"), edges[c]) for c in columns})
