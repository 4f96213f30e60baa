"""What all selectors share: parameters, the fitted model, and projection onto the selected features."""

from __future__ import annotations

import copy
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.dataset import FeatureFrame

STRATEGIES = ("auto", "sql", "block")


class NotFittedError(ValueError):
    """transform was called on something that hasn't been fitted."""


def check_strategy(strategy: str, allowed: Sequence[str] = STRATEGIES) -> None:
    if strategy not in allowed:
        raise ValueError(f"strategy must be one of {', '.join(allowed)}")


@dataclass
class FittedSelector:
    """What a selector has learnt. top_features: positions of the selected features, in the selector's order."""

    feature_cols: tuple[str, ...]
    top_features: list[int]
    feature_importances: list[float] | None = None
    is_discrete: list[bool] | None = None
    classes: list | None = None
    details: dict = field(default_factory=dict)
    #: The array column whose components the features are.
    array_col: str | None = None

    @property
    def n_features_in(self) -> int:
        return len(self.feature_cols)

    @property
    def selected(self) -> list[str]:
        return [self.feature_cols[k] for k in self.top_features]

    def support(self) -> list[bool]:
        chosen = set(self.top_features)
        return [k in chosen for k in range(self.n_features_in)]

    def transform(self, df: DataFrame, keep: Sequence[str] = (), feature_cols: Sequence[str] | None = None, kind: str = "the selector") -> DataFrame:
        """The columns in keep, then the selected features (of an array column: that column with the selected components). feature_cols: this table's features, where they aren't those of fit."""
        if self.array_col is not None:
            return df.select(*keep, F.array(*[F.get(self.array_col, k) for k in self.top_features]).alias(self.array_col))
        mine = tuple(feature_cols) if feature_cols is not None else tuple(c for c in df.columns if c not in keep) if not set(self.feature_cols) <= set(df.columns) else self.feature_cols
        if len(mine) != self.n_features_in:
            raise ValueError(f"X has {len(mine)} features, but {kind} is expecting {self.n_features_in} features as input.")
        return df.select(*keep, *[mine[k] for k in self.top_features])

    def inverse_transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """All features of fit again, with 0 for those that weren't selected."""
        chosen = set(self.selected)
        missing = [c for c in chosen if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(sorted(missing))}")
        return df.select(*keep, *[c if c in chosen else F.lit(0.0).alias(c) for c in self.feature_cols])

    def scores(self, spark: SparkSession) -> DataFrame:
        """(feature_idx, feature, is_discrete, score, rank), one row a feature."""
        from lakesift.functions.selection import ranked

        scores = self.feature_importances or []
        place = {k: r for r, k in enumerate(ranked(scores), 1)}
        flags = self.is_discrete or [None] * len(scores)
        rows = [(k, self.feature_cols[k], flags[k], float(s), place[k]) for k, s in enumerate(scores)]
        return spark.createDataFrame(rows, "feature_idx int, feature string, is_discrete boolean, score double, rank int")


class Parameters:
    """A dataclass of parameters that can be read, set and copied."""

    def get_params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def set_params(self, **params):
        for name, value in params.items():
            if name not in {f.name for f in fields(self)}:
                raise ValueError(f"no parameter {name}")
            setattr(self, name, value)
        return self

    def clone(self):
        return type(self)(**copy.copy(self.get_params()))


class Selector(Parameters):
    """A selector is a dataclass of its parameters; fit gives a FittedSelector and keeps it as model."""

    model: FittedSelector | None = None

    def fit(self, df: DataFrame, label_col: str, feature_cols: Sequence[str] | str | None = None, id_col: str | None = None) -> FittedSelector:
        self.model = self.fit_frame(FeatureFrame.of(df, label_col, feature_cols, id_col))
        return self.model

    def fit_frame(self, frame: FeatureFrame) -> FittedSelector:
        raise NotImplementedError

    def transform(self, df: DataFrame, keep: Sequence[str] = (), feature_cols: Sequence[str] | None = None) -> DataFrame:
        if self.model is None:
            raise NotFittedError(f"this {type(self).__name__} isn't fitted yet")
        return self.model.transform(df, keep, feature_cols, type(self).__name__)

    def fit_transform(self, df: DataFrame, label_col: str, feature_cols: Sequence[str] | None = None, id_col: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
        self.fit(df, label_col, feature_cols, id_col)
        return self.transform(df, keep)

    def support(self) -> list[bool]:
        if self.model is None:
            raise NotFittedError(f"this {type(self).__name__} isn't fitted yet")
        return self.model.support()
