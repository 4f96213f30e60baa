"""Recursive elimination: score, drop the lowest, score the rest again.

An estimator that can prepare its rows once (`scorer`) does so, and each round only scores; others are fitted anew on the features that are left.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from lakesift.dataset import FeatureFrame
from lakesift.operators.base import FittedSelector, Selector

log = logging.getLogger(__name__)


@dataclass
class TuRF(Selector):
    """estimator: a selector whose fitted model has feature_importances. The survivors come in the order of the features."""

    estimator: Selector
    n_features_to_select: int = 10
    pct_remove: float = 0.1
    n_iterations: int | None = None
    verbose: bool = False

    def fit_frame(self, frame: FeatureFrame) -> FittedSelector:
        if not 0 < self.pct_remove < 1:
            raise ValueError("pct_remove must be between 0 and 1, exclusive")
        if self.n_features_to_select < 1:
            raise ValueError("n_features_to_select must be at least 1")

        own = self.estimator.clone()
        if hasattr(own, "n_features_to_select"):
            own.n_features_to_select = 1  # only the scores are used
        prepared = own.scorer(frame) if hasattr(own, "scorer") else None

        def scored(active: list[int]) -> FittedSelector:
            if prepared is not None:
                return prepared(active)
            if frame.array_col is not None:
                raise ValueError(f"{type(own).__name__} doesn't score a part of an array column")
            names = tuple(frame.feature_cols[k] for k in active)
            return own.clone().fit_frame(FeatureFrame(frame.df, frame.label_col, names, frame.id_col))

        try:
            return self._eliminated(frame, scored)
        finally:
            if prepared is not None:
                prepared.close()

    def _eliminated(self, frame: FeatureFrame, scored: Callable[[list[int]], FittedSelector]) -> FittedSelector:
        active, done, rounds = list(range(frame.n_features)), 0, []
        first = now = scored(active)
        while len(active) > self.n_features_to_select and (self.n_iterations is None or done < self.n_iterations):
            drop = min(max(1, int(len(active) * self.pct_remove)), len(active) - self.n_features_to_select)
            lowest = sorted(range(len(active)), key=lambda k: (now.feature_importances[k], active[k]))[:drop]
            rounds.append([active[k] for k in sorted(lowest)])
            active = [f for k, f in enumerate(active) if k not in set(lowest)]
            done += 1
            if self.verbose:
                log.info("round %d: %d features left", done, len(active))
            if len(active) > self.n_features_to_select and (self.n_iterations is None or done < self.n_iterations):
                now = scored(active)
        return FittedSelector(frame.feature_cols, active, first.feature_importances, first.is_discrete, first.classes, {"dropped": rounds}, frame.array_col)
