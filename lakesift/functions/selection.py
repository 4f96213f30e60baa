"""How many features to keep, and in which order."""

from __future__ import annotations

from collections.abc import Sequence


def selection_count(wanted: float | int, n_features: int) -> int:
    """A share in (0, 1] of the features, at least one, or a number of them."""
    if isinstance(wanted, bool) or not isinstance(wanted, (int, float)):
        raise TypeError("n_features_to_select must be an int or a float")
    if isinstance(wanted, float):
        if not 0.0 < wanted <= 1.0:
            raise ValueError("n_features_to_select as a float must be in (0, 1]")
        return max(1, int(wanted * n_features))
    if not 1 <= wanted <= n_features:
        raise ValueError(f"n_features_to_select as an int must be from 1 to {n_features}")
    return wanted


def ranked(scores: Sequence[float]) -> list[int]:
    """Feature positions, the highest score first; of equal scores the later feature first."""
    return sorted(range(len(scores)), key=lambda k: (-scores[k], -k))
