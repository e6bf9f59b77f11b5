"""The governance preprocessor as ``pyspark.ml`` stages (Y1): usable in a Pipeline, saved and loaded with it."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from .. import constants as K
from .preprocess import GovernancePreprocessor, PreprocessorModel


class GovernanceStage(Estimator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``GovernancePreprocessor`` on all columns but the label and ``keyCol``."""

    missingThreshold = Param(Params._dummy(), "missingThreshold", "largest share of missing values that is kept", TypeConverters.toFloat)
    varianceThreshold = Param(Params._dummy(), "varianceThreshold", "variance up to which a column is dropped", TypeConverters.toFloat)
    maxLeakageCorrelation = Param(Params._dummy(), "maxLeakageCorrelation", "correlation with the label from which a column leaks", TypeConverters.toFloat)
    numericStrategy = Param(Params._dummy(), "numericStrategy", "median or mean", TypeConverters.toString)
    categoricalStrategy = Param(Params._dummy(), "categoricalStrategy", "most_frequent or constant_missing", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "the rows' key, passed through", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol: str = K.TARGET_COLUMN, keyCol: str = "", missingThreshold: float = K.MISSING_THRESHOLD,
                 varianceThreshold: float = K.VARIANCE_THRESHOLD, maxLeakageCorrelation: float = K.LEAKAGE_CORRELATION,
                 numericStrategy: str = "median", categoricalStrategy: str = "most_frequent") -> None:
        super().__init__()
        self._setDefault(labelCol=K.TARGET_COLUMN, keyCol="", missingThreshold=K.MISSING_THRESHOLD, varianceThreshold=K.VARIANCE_THRESHOLD,
                         maxLeakageCorrelation=K.LEAKAGE_CORRELATION, numericStrategy="median", categoricalStrategy="most_frequent")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GovernanceStageModel:
        names = [self.missingThreshold, self.varianceThreshold, self.maxLeakageCorrelation, self.numericStrategy, self.categoricalStrategy]
        fitted = GovernancePreprocessor(*[self.getOrDefault(p) for p in names]).fit(dataset, self.getLabelCol(), exclude=[c for c in [self.getOrDefault(self.keyCol)] if c])
        return GovernanceStageModel(state=json.dumps(asdict(fitted)))


class GovernanceStageModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted columns and fills, held as one parameter."""

    state = Param(Params._dummy(), "state", "the fitted preprocessor as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state: str = "") -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def fitted(self) -> PreprocessorModel:
        return PreprocessorModel(**json.loads(self.getOrDefault(self.state)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)
