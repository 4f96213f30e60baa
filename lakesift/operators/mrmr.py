"""Selection of features that tell much about the label and little about each other.

Relevance takes one counting of cells. Redundancy is counted only between a feature that has been selected and
those that haven't, step by step, so p * m pairs are counted and not p * p; the loop on the
driver holds p numbers. With redundancy "all" every pair is counted in one scan of the rows, and the whole matrix is kept: that is
less work where the rows cost more than the pairs.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lakesift.dataset import FeatureFrame
from lakesift.functions.information import mutual_information
from lakesift.operators.base import FittedSelector, Selector
from lakesift.operators.contingency import cells

METHODS = ("MID", "MIQ")
REDUNDANCY = ("steps", "all")
#: Scores this close to the best are ties, which the smaller mean redundancy decides.
NEAR_ABS, NEAR_REL = 1e-12, 1e-5
SMALL = 1e-9
DIGITS = 12


def _mi(df: DataFrame, pairs: list[tuple[str, str]]) -> list[float]:
    """Rounded, as sums of doubles hang on their order in the last digits, and features that are copies must tie."""
    found = dict(mutual_information(cells(df, pairs), "bit").collect()) if pairs else {}
    return [round(found.get(k, 0.0), DIGITS) for k in range(len(pairs))]


def best_candidate(scores: dict[int, float], mean_redundancy: dict[int, float]) -> int:
    top = max(scores.values())
    near = [k for k, s in scores.items() if abs(s - top) <= NEAR_ABS + NEAR_REL * abs(top)]
    return min(near, key=lambda k: (mean_redundancy[k], k))


@dataclass
class MRMR(Selector):
    n_features_to_select: int
    method: str = "MID"
    redundancy: str = "steps"

    def __post_init__(self) -> None:
        if self.redundancy not in REDUNDANCY:
            raise ValueError(f"redundancy must be one of {', '.join(REDUNDANCY)}")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")

    def fit_frame(self, frame: FeatureFrame) -> FittedSelector:
        p, wanted = frame.n_features, self.n_features_to_select
        if isinstance(wanted, bool) or not isinstance(wanted, int) or not 0 < wanted <= p:
            raise ValueError(f"n_features_to_select must be from 1 to {p}")
        for c in [*frame.feature_cols, frame.label_col]:
            if not frame.is_integral(c) and not (c == frame.label_col and not frame.is_continuous(c)):
                raise ValueError(f"{c} must be of an integer type")
        frame.checked()
        labelled = [(c, frame.label_col) for c in frame.feature_cols]
        index = list(itertools.combinations(range(p), 2)) if self.redundancy == "all" else []
        found = _mi(frame.df, [*labelled, *[(frame.feature_cols[i], frame.feature_cols[j]) for i, j in index]])
        relevance, every = found[:p], dict(zip(index, found[p:]))
        first = max(range(p), key=lambda k: (relevance[k], -k))
        chosen, steps, sums = [first], [relevance[first]], dict.fromkeys(range(p), 0.0)
        redundancy: dict[tuple[int, int], float] = {}
        while len(chosen) < wanted:
            rest = [k for k in range(p) if k not in chosen]
            last = chosen[-1]
            between = [every[min(k, last), max(k, last)] for k in rest] if every else _mi(frame.df, [(frame.feature_cols[last], frame.feature_cols[k]) for k in rest])
            for k, mi in zip(rest, between):
                sums[k] += mi
                redundancy[min(k, last), max(k, last)] = mi
            mean = {k: sums[k] / len(chosen) for k in rest}
            scores = {k: relevance[k] - mean[k] if self.method == "MID" else relevance[k] / (mean[k] + SMALL) for k in rest}
            chosen.append(best_candidate(scores, mean))
            steps.append(scores[chosen[-1]])
        details = {"step_scores": steps, "redundancy": every or redundancy}
        if self.redundancy == "all":
            details["redundancy_matrix"] = [[every.get((min(i, j), max(i, j)), 0.0) for j in range(p)] for i in range(p)]
        return FittedSelector(frame.feature_cols, chosen, relevance, details=details)


def merit(r_cf: list[float], r_ff: dict[tuple[int, int], float], chosen: list[int]) -> float:
    """Mean relevance against mean redundancy of a subset, as one fraction."""
    k = len(chosen)
    if not k:
        return 0.0
    between = sum(r_ff.get((min(a, b), max(a, b)), 0.0) for i, a in enumerate(chosen) for b in chosen[i + 1 :])
    below = math.sqrt(max(0.0, k + 2 * between))
    return sum(r_cf[a] for a in chosen) / below if below > 1e-12 else 0.0
