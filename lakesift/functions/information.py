"""Entropies over tables of cell counts.

A table of cells has the columns pair, x, y and n: how many rows hold the values x and y of the two columns of a pair.
It has as many rows as there are different cells, whatever the size of the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def shares(cells: DataFrame) -> DataFrame:
    """cells with p, px and py: the shares of the cell, of its x and of its y among the rows of the pair.

    Margins are sums that tasks begin before the shuffle, joined to the cells by pair and value; so no pair's cells are gathered in one task.
    """
    cells = cells.withColumnsRenamed({"x": "cell_x", "y": "cell_y"})
    mine = cells
    for name in ("x", "y"):
        margin = cells.groupBy(F.col("pair").alias(f"{name}_pair"), F.col(f"cell_{name}").alias(name)).agg(F.sum("n").cast("double").alias(f"n{name}"))
        mine = mine.join(margin, (F.col("pair") == F.col(f"{name}_pair")) & F.col(f"cell_{name}").eqNullSafe(F.col(name)))
    whole = cells.groupBy(F.col("pair").alias("whole_pair")).agg(F.sum("n").cast("double").alias("whole"))
    mine = mine.join(whole, F.col("pair") == F.col("whole_pair"))
    return mine.select("pair", "x", "y", (F.col("n") / F.col("whole")).alias("p"), (F.col("nx") / F.col("whole")).alias("px"), (F.col("ny") / F.col("whole")).alias("py"))


def mutual_information(cells: DataFrame, unit: str = "bit") -> DataFrame:
    """(pair, mi), with a small number added under the fraction."""
    if unit not in ("bit", "nat"):
        raise ValueError("unit must be 'bit' or 'nat'")
    term = F.when(F.col("p") > EPS, F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py") + EPS))).otherwise(0.0)
    base = math.log(2) if unit == "bit" else 1.0
    return shares(cells).groupBy("pair").agg((F.sum(term) / base).alias("mi"))


def _entropy(share: Column, cell: Column) -> Column:
    """Sums to the entropy over the cells, which a value's share is spread over."""
    return -F.sum(F.when(share > EPS, cell * F.log2(share)).otherwise(0.0))


def symmetrical_uncertainty(cells: DataFrame) -> DataFrame:
    """(pair, su, hx, hy): twice the mutual information in parts of the sum of both entropies; 0 where that is nearly 0."""
    p, px, py = F.col("p"), F.col("px"), F.col("py")
    sums = shares(cells).groupBy("pair").agg(
        F.sum(F.when(p > EPS, p * F.log2(p / (px * py))).otherwise(0.0)).alias("mi"), _entropy(px, p).alias("hx"), _entropy(py, p).alias("hy")
    )
    both = F.col("hx") + F.col("hy")
    return sums.select("pair", F.when(both < EPS, 0.0).otherwise(2 * F.col("mi") / F.when(both < EPS, 1.0).otherwise(both)).alias("su"), "hx", "hy")
