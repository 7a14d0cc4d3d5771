"""Preparation steps as Spark ML stages that are saved with a model.

Each estimator fits a handful of numbers (exactly, by :mod:`.quantiles` and one aggregate) and its model
holds them as parameters, so ``Pipeline`` and ``PipelineModel`` save and load them like any other stage:
one saved object prepares and scores.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import fit_yeo_johnson, yeo_johnson
from .quantiles import quantiles


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """``inputCols`` to ``outputCols``, one to one."""

    def _pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.getInputCols(), self.getOutputCols()))

    def _fitted(self, model: Model, **values) -> Model:
        return model._set(inputCols=self.getInputCols(), outputCols=self.getOutputCols(), **values)


def _numbers(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=TypeConverters.toListFloat)


class MedianFill(_Columns, Estimator):
    """Gaps (null or NaN) take the exact median of the training rows; a column without values takes 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianFillModel:
        q = quantiles(dataset, self.getInputCols(), [0.5])
        return self._fitted(MedianFillModel(), medians=[q[c][0] if q[c][0] is not None else 0.0 for c in self.getInputCols()])


class MedianFillModel(_Columns, Model):
    medians = _numbers("medians", "a median for each column")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({o: F.coalesce(F.nanvl(F.col(i).cast("double"), F.lit(None).cast("double")), F.lit(m))
                                    for (i, o), m in zip(self._pairs(), self.getOrDefault(self.medians))})


class ExactRobustScaler(_Columns, Estimator):
    """M2: ``(x - median) / IQR`` with interpolated quartiles; an IQR of 0 leaves the centred value."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExactRobustScalerModel:
        q = quantiles(dataset, self.getInputCols(), [0.25, 0.5, 0.75])
        known = [q[c] if q[c][0] is not None else [0.0] * 3 for c in self.getInputCols()]
        return self._fitted(ExactRobustScalerModel(), centers=[m for _, m, _ in known], scales=[(b - a) or 1.0 for a, _, b in known])


class ExactRobustScalerModel(_Columns, Model):
    centers = _numbers("centers", "a median for each column")
    scales = _numbers("scales", "an interquartile range (1 for 0) for each column")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = zip(self._pairs(), self.getOrDefault(self.centers), self.getOrDefault(self.scales))
        return dataset.withColumns({o: (F.col(i).cast("double") - F.lit(c)) / F.lit(s) for (i, o), c, s in fitted})


class YeoJohnson(_Columns, Estimator):
    """M4: the transform of largest likelihood, then ``(y - mean) / std`` (0 for a column of one value)."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> YeoJohnsonModel:
        cols = self.getInputCols()
        lam = fit_yeo_johnson(dataset, cols)
        y = [yeo_johnson(F.col(c).cast("double"), lam[c]) for c in cols]
        row = dataset.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(y)], *[F.stddev_pop(e).alias(f"s{i}") for i, e in enumerate(y)]).first()
        return self._fitted(YeoJohnsonModel(), lambdas=[lam[c] for c in cols], means=[row[f"m{i}"] or 0.0 for i in range(len(cols))],
                            deviations=[row[f"s{i}"] or 0.0 for i in range(len(cols))])


class YeoJohnsonModel(_Columns, Model):
    lambdas = _numbers("lambdas", "a lambda for each column")
    means = _numbers("means", "a mean for each transformed column")
    deviations = _numbers("deviations", "a standard deviation for each transformed column")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = {}
        for (i, o), lam, m, s in zip(self._pairs(), *(self.getOrDefault(p) for p in (self.lambdas, self.means, self.deviations))):
            x = F.col(i).cast("double")
            out[o] = (yeo_johnson(x, lam) - F.lit(m)) / F.lit(s) if s > 0 else F.when(x.isNotNull(), F.lit(0.0))
        return dataset.withColumns(out)


class FeatureWeights(_Columns, Transformer):
    """M5: each column times its weight."""
    weights = _numbers("weights", "a weight for each column")

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, weights=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({o: F.col(i) * F.lit(w) for (i, o), w in zip(self._pairs(), self.getOrDefault(self.weights))})
