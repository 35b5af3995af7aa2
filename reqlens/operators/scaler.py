"""M4 and M5 as a stage of a Spark ML pipeline: mean and population standard
deviation of each feature, learnt from the rows the pipeline is fitted on (Spark
ML's own scaler divides by the sample deviation)."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def population_std(x: Column) -> Column:
    """Aggregate: population standard deviation, exactly 0 where all values are
    equal (the running formula leaves rounding of about 1e-16 there)."""
    return F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.stddev_pop(x))


class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fits :class:`PopulationScalerModel`; null values of a feature do not
    count, a feature without values has mean and scale 0."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PopulationScalerModel":
        cols = self.getInputCols()
        row = dataset.agg(*[f(F.col(c).cast("double")) for c in cols for f in (F.avg, population_std)]).first()
        return PopulationScalerModel(inputCols=cols, outputCols=self.getOutputCols(), mean=[float(x or 0.0) for x in row[::2]],
                                     scale=[float(x or 0.0) for x in row[1::2]])


class PopulationScalerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """``(x - mean) / scale`` per column, 0 where the scale is 0, null where the
    value is."""

    mean: Param = Param(Params._dummy(), "mean", "mean of each input column", TypeConverters.toListFloat)
    scale: Param = Param(Params._dummy(), "scale", "population standard deviation of each", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None,
                 mean: list[float] | None = None, scale: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made = {}
        for c, out, m, s in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.mean), self.getOrDefault(self.scale)):
            x = F.col(c).cast("double")
            made[out] = F.when(x.isNotNull(), F.lit(0.0)) if s == 0.0 else (x - F.lit(m)) / F.lit(s)
        return dataset.withColumns(made)
