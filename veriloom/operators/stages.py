"""Fitted feature engineering as a Spark ML estimator and model, for use in a ``Pipeline`` and with its persistence."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions.ordered import quantiles
from veriloom.operators import features

OUTPUTS = ("composite_risk_score", "fraud_risk_score", "high_amount", "above_usual")


class _Columns(Params):
    """Columns the features are made of; an empty name leaves the features of a column out."""

    amount = Param(Params._dummy(), "amount", "claimed amount", typeConverter=TypeConverters.toString)
    age = Param(Params._dummy(), "age", "age in years", typeConverter=TypeConverters.toString)
    duration = Param(Params._dummy(), "duration", "policy duration in months", typeConverter=TypeConverters.toString)
    negative = Param(Params._dummy(), "negative", "share of negative words", typeConverter=TypeConverters.toString)

    def _name(self, param: Param) -> str | None:
        return self.getOrDefault(param) or None


class FeatureStage(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the range, mean, 80 and 95 % quantiles of the amount.

    What is scored later is measured against the rows the stage was fitted on,
    not against whatever is scored together. Nulls and NaN are left out; without
    any amount every feature that needs it is null or 0.
    """

    @keyword_only
    def __init__(self, *, amount: str = "claim_amount", age: str = "", duration: str = "", negative: str = ""):
        super().__init__()
        self._setDefault(amount="claim_amount", age="", duration="", negative="")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "FeatureStageModel":
        name = self.getOrDefault(self.amount)
        value = F.col(name).cast("double")
        rows = dataset.select(F.when(~F.isnan(value), value).alias("amount"))
        ends = rows.agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.avg("amount").alias("mean")).first().asDict()
        marks = quantiles(rows, ["amount"], {"p80": 0.8, "p95": 0.95}).select("p80", "p95").first().asDict() if ends["lo"] is not None else {"p80": None, "p95": None}
        return self._copyValues(FeatureStageModel(statistics={**ends, **marks}))


class FeatureStageModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ratios and products of the columns, the risk and fraud scores and flags for large amounts, by the statistics of the fit."""

    statistics = Param(Params._dummy(), "statistics", "lo, hi, mean, p80 and p95 of the amount")

    def __init__(self, statistics: dict | None = None):
        super().__init__()
        self._setDefault(amount="claim_amount", age="", duration="", negative="", statistics={})
        if statistics is not None:
            self._set(statistics=statistics)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        learnt = {n: F.lit(v).cast("double") for n, v in self.getOrDefault(self.statistics).items()}
        amount, age, duration, negative = (self._name(p) for p in (self.amount, self.age, self.duration, self.negative))
        pairs = [(a, b) for a, b in ((amount, age), (amount, duration), (age, duration)) if a and b]
        out = features.interactions(features.ratios(dataset, pairs), pairs)
        ends = dataset.sparkSession.range(1).select(learnt["lo"].alias("lo"), learnt["hi"].alias("hi"))
        out = features.composite_risk(out, amount, age, duration, negative, ends)
        out = features.fraud_score(out, amount, negative, p95=learnt["p95"])
        return out.withColumns({"high_amount": F.coalesce((F.col(amount) > learnt["p80"]).cast("int"), F.lit(0)),
                                "above_usual": F.col(amount).cast("double") - learnt["mean"]})
