"""Correlation-based subset selection by symmetrical uncertainty.

Continuous columns are binned, cells are counted, a greedy search on the driver adds the feature that raises the merit most,
and features that a kept one makes redundant are dropped. Only features whose relevance reaches `min_r_cf` can ever be compared, so
only pairs of those are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from lakesift.dataset import FeatureFrame
from lakesift.functions.binning import STRATEGIES, binned
from lakesift.functions.information import symmetrical_uncertainty
from lakesift.operators.base import FittedSelector, Selector
from lakesift.operators.contingency import cells
from lakesift.operators.mrmr import DIGITS, merit

MIN_R_CF = 0.1


def search(r_cf: list[float], r_ff: dict[tuple[int, int], float], min_r_cf: float = MIN_R_CF) -> list[int]:
    """Features in the order in which the greedy search adds them."""
    if not r_cf:
        return []
    first = max(range(len(r_cf)), key=lambda k: (r_cf[k], -k))
    if r_cf[first] < min_r_cf:
        return []
    chosen, now = [first], merit(r_cf, r_ff, [first])
    while True:
        best, value = None, now
        for k in range(len(r_cf)):
            if k not in chosen and r_cf[k] >= min_r_cf and (m := merit(r_cf, r_ff, [*chosen, k])) > value:
                best, value = k, m
        if best is None:
            return chosen
        chosen.append(best)
        now = value


def prune(chosen: list[int], r_cf: list[float], r_ff: dict[tuple[int, int], float]) -> list[int]:
    """Without features that are at least as close to a kept, more relevant one as to the label."""
    kept: list[int] = []
    for k in sorted(chosen, key=lambda k: (-r_cf[k], k)):
        if all(r_ff.get((min(j, k), max(j, k)), 0.0) < r_cf[k] for j in kept):
            kept.append(k)
    return sorted(kept)


@dataclass
class CFS(Selector):
    n_bins: int = 10
    binning: str = "uniform"
    min_r_cf: float = MIN_R_CF

    def __post_init__(self) -> None:
        if self.binning not in STRATEGIES:
            raise ValueError(f"binning must be one of {', '.join(STRATEGIES)}")

    def fit_frame(self, frame: FeatureFrame) -> FittedSelector:
        frame.checked(least_rows=2)
        names = frame.feature_cols
        coded = binned(frame.df, [c for c in names if frame.is_continuous(c)], self.n_bins, self.binning)

        def su(pairs: list[tuple[str, str]]) -> list[float]:
            found = {r["pair"]: r["su"] for r in symmetrical_uncertainty(cells(coded, pairs)).collect()} if pairs else {}
            return [round(found.get(k, 0.0), DIGITS) for k in range(len(pairs))]

        r_cf = su([(c, frame.label_col) for c in names])
        able = [k for k, r in enumerate(r_cf) if r >= self.min_r_cf]
        index = [(a, b) for i, a in enumerate(able) for b in able[i + 1 :]]
        r_ff = dict(zip(index, su([(names[a], names[b]) for a, b in index])))
        kept = prune(search(r_cf, r_ff, self.min_r_cf), r_cf, r_ff)
        return FittedSelector(names, kept, r_cf, details={"merit": merit(r_cf, r_ff, kept), "r_ff": r_ff})
