"""Selectors as stages of a pyspark.ml Pipeline, with parameters for grids, and saved and loaded with it.

A stage names its operator and holds the operator's own parameters as one parameter, `settings`; so a grid goes over settings:

    stage = SelectorStage(ReliefF(n_neighbors=3), "y", names, "id")
    grid = ParamGridBuilder().addGrid(stage.settings, [{"n_neighbors": 3}, {"n_neighbors": 5}]).build()
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from lakesift.operators.base import FittedSelector, Parameters, Selector
from lakesift.operators.cfs import CFS
from lakesift.operators.mdr import MDR, FittedMDR
from lakesift.operators.mrmr import MRMR
from lakesift.operators.relief import SURF, MultiSURF, ReliefF
from lakesift.operators.turf import TuRF

OPERATORS = {kind.__name__: kind for kind in (ReliefF, SURF, MultiSURF, TuRF, MRMR, CFS, MDR)}


def described(operator: Parameters) -> dict:
    """An operator's name and parameters as plain values; operators among the parameters are described too."""
    return {"operator": type(operator).__name__, "settings": {k: described(v) if isinstance(v, Parameters) else v for k, v in operator.get_params().items()}}


def made(description: dict) -> Parameters:
    """The operator that is described."""
    return OPERATORS[description["operator"]](**{k: made(v) if isinstance(v, dict) and "operator" in v else v for k, v in description["settings"].items()})


class _Columns(Params):
    labelCol = Param(Params._dummy(), "labelCol", "the label's column", TypeConverters.toString)
    featureCols = Param(Params._dummy(), "featureCols", "the features' columns, or one array column", TypeConverters.identity)
    idCol = Param(Params._dummy(), "idCol", "the rows' id, for operators that compare rows", TypeConverters.identity)
    operator = Param(Params._dummy(), "operator", "the operator's name", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "the operator's parameters; those that are left out keep their defaults", TypeConverters.identity)

    def getOperator(self) -> Parameters:
        return made({"operator": self.getOrDefault(self.operator), "settings": self.getOrDefault(self.settings)})

    def _given(self, operator: Parameters | None, **columns) -> None:
        if operator is not None:
            found = described(operator)
            self._set(operator=found["operator"], settings=found["settings"])
        self._set(**{k: list(v) if k == "featureCols" and not isinstance(v, str) else v for k, v in columns.items() if v is not None})

    def _columns(self) -> tuple:
        return self.getOrDefault(self.labelCol), self.getOrDefault(self.featureCols), self.getOrDefault(self.idCol) if self.isDefined(self.idCol) else None


class _Fitted(Params):
    state = Param(Params._dummy(), "state", "what was learnt, as plain values", TypeConverters.identity)


class SelectorModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the columns that aren't features, and the selected features."""

    def __init__(self, fitted: FittedSelector | None = None) -> None:
        super().__init__()
        if fitted is not None:
            state = asdict(fitted)
            state["details"] = {k: v for k, v in state["details"].items() if not isinstance(v, dict)}  # tables of pairs aren't part of the model
            self._set(state=state)

    @property
    def fitted(self) -> FittedSelector:
        state = dict(self.getOrDefault(self.state))
        return FittedSelector(**state | {"feature_cols": tuple(state["feature_cols"])})

    def getSupport(self) -> list[bool]:
        return self.fitted.support()

    def getFeatureNamesOut(self) -> list[str]:
        return self.fitted.selected

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = self.fitted
        if fitted.array_col is not None:
            return fitted.transform(dataset, keep=[c for c in dataset.columns if c != fitted.array_col])
        others = [c for c in dataset.columns if c not in fitted.feature_cols]
        return fitted.transform(dataset, keep=others, feature_cols=fitted.feature_cols)


class SelectorStage(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a selector on the labelled table that reaches this stage."""

    def __init__(self, selector: Selector | None = None, labelCol: str | None = None, featureCols: Sequence[str] | str | None = None, idCol: str | None = None) -> None:
        super().__init__()
        self._given(selector, labelCol=labelCol, featureCols=featureCols, idCol=idCol)

    def _fit(self, dataset: DataFrame) -> SelectorModel:
        return SelectorModel(self.getOperator().fit(dataset, *self._columns()))


class InteractionModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the constructed feature."""

    outputCol = Param(Params._dummy(), "outputCol", "the constructed feature's column", TypeConverters.toString)

    def __init__(self, fitted: FittedMDR | None = None, output: str | None = None) -> None:
        super().__init__()
        self._setDefault(outputCol="mdr")
        if fitted is not None:
            self._set(state=asdict(fitted))
        if output is not None:
            self._set(outputCol=output)

    @property
    def fitted(self) -> FittedMDR:
        state = dict(self.getOrDefault(self.state))
        return FittedMDR(**state | {k: tuple(state[k]) for k in ("feature_cols", "best_interaction")})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset, self.getOrDefault(self.outputCol))


class InteractionStage(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Searches the interaction on the labelled table that reaches this stage."""

    outputCol = Param(Params._dummy(), "outputCol", "the constructed feature's column", TypeConverters.toString)

    def __init__(self, search: MDR | None = None, labelCol: str | None = None, featureCols: Sequence[str] | None = None, idCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._setDefault(outputCol="mdr")
        self._given(search, labelCol=labelCol, featureCols=featureCols, idCol=idCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> InteractionModel:
        return InteractionModel(self.getOperator().fit(dataset, *self._columns()), self.getOrDefault(self.outputCol))
