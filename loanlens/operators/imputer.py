"""Median imputation as a pipeline stage with exact medians.

``pyspark.ml.feature.Imputer`` returns an element near the median; this stage returns the median itself, the mean of the two
middle values for an even count, found by range-split running counts (``ordered.exact_medians``). The fitted
model is a projection, is saved and loaded with its pipeline, and is fitted anew wherever the pipeline is.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import exact_medians


def present(name: str) -> Column:
    """The column as a double, NaN counting as missing."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)


class ExactMedianImputer(_Columns, Estimator):
    def _fit(self, dataset: DataFrame) -> "ExactMedianModel":
        names = self.getInputCols()
        found = exact_medians(dataset.select(*[present(c).alias(c) for c in names]), names)
        model = ExactMedianModel(inputCols=names, outputCols=self.getOutputCols())
        # a column without any value is filled with 0
        return model._set(medians=[float(found[c]) if found[c] is not None else 0.0 for c in names])


class ExactMedianModel(_Columns, Model):
    medians = Param(Params._dummy(), "medians", "fitted median of each input column", typeConverter=TypeConverters.toListFloat)

    def fitted(self) -> dict[str, float]:
        return dict(zip(self.getInputCols(), self.getOrDefault(self.medians)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fill = self.getOrDefault(self.medians)
        return dataset.select("*", *[F.coalesce(present(c), F.lit(m)).alias(o)
                                     for c, m, o in zip(self.getInputCols(), fill, self.getOutputCols())])
