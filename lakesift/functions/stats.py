"""Chi-squared survival function for whole degrees of freedom."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Even degrees of freedom up to which the finite sum is written out as an expression.
FEW = 20
VALUES_AT_ONCE = 256


def chi2_sf_values(x: np.ndarray, dof: int) -> np.ndarray:
    """P(X > x). A finite sum of terms, each from its logarithm, so that none overflows; odd degrees of freedom begin with erfc."""
    half = np.maximum(np.asarray(x, float), 0.0) / 2
    odd = dof % 2
    steps = np.arange(dof // 2) + (0.5 if odd else 0.0)  # powers of half
    below = np.array([math.lgamma(t + 1) for t in steps])
    out = np.empty(len(half))
    for at in range(0, len(half), VALUES_AT_ONCE):
        h = half[at : at + VALUES_AT_ONCE]
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = steps[None, :] * np.log(h)[:, None] - below[None, :] - h[:, None]
        logs[h == 0] = np.where(steps == 0, 0.0, -np.inf)
        out[at : at + VALUES_AT_ONCE] = np.exp(logs).sum(axis=1)
    if odd:
        out += [math.erfc(math.sqrt(h)) for h in half.tolist()]
    return np.minimum(out, 1.0)


def chi2_sf_value(x: float, dof: int) -> float:
    return float(chi2_sf_values(np.array([x]), dof)[0])


def chi2_sf(stat: Column, dof: int) -> Column:
    """P(X > stat). Few even degrees of freedom stay an expression; others take one function over a row a feature."""
    if dof <= 0:
        return F.lit(1.0)
    if dof % 2 == 0 and dof <= FEW:
        half = stat / 2
        terms = [F.lit(1.0)]
        for t in range(1, dof // 2):
            terms.append(terms[-1] * half / t)
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return F.exp(-half) * total

    @F.arrow_udf("double")
    def tail(x: pa.Array) -> pa.Array:
        known = np.asarray(x.is_valid())
        found = chi2_sf_values(x.fill_null(0.0).to_numpy(zero_copy_only=False), dof)
        return pa.array(found, mask=~known)

    return tail(stat.cast("double"))
