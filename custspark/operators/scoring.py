"""The scored customer table: segment, eco label, churn and value on one row
per customer.

Each score is a step, a function that takes the customer table and returns
it with its own columns added; a step that is ``None`` (no model at hand)
adds nulls instead, so that the table always has the same columns.  The
steps here wrap fitted models; tests and SQL twins use fixed formulas.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..session import cut_lineage
from . import models, segments
from .boosting import BoostedModel

Step = Callable[[DataFrame], DataFrame]

SCORE_COLUMNS = ["KMeans_Segment", "Segment_Label", "Pred_Green_Class", "Pred_Green_Score", "Eco_Segment",
                 "Predicted_Churn", "Predicted_CLTV"]


def _nulls(df: DataFrame, **types: str) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items()})


def score_customers(df: DataFrame, segment: Step | None = None, green: Step | None = None, churn: Step | None = None,
                    value: Step | None = None, names: Sequence[str] = segments.DASHBOARD_NAMES) -> DataFrame:
    """``df`` with :data:`SCORE_COLUMNS`.  ``segment`` adds ``KMeans_Segment`` (named by the cluster
    means), ``green`` adds class and score (the score is clipped to 0..1 and labelled unrounded; a row
    without a class has no label), ``churn`` and ``value`` one prediction each.  The segmented
    table is written once, as naming reads it before the scores do."""
    if segment is None:
        out = _nulls(df, KMeans_Segment="int", Segment_Label="string")
    else:
        out = segments.label_segments(cut_lineage(segment(df)), names=names)
    out = _nulls(out, Pred_Green_Class="double", Pred_Green_Score="double") if green is None else green(out)
    out = out.withColumn("Pred_Green_Score", fx.clip("Pred_Green_Score", 0.0, 1.0))
    out = out.withColumn("Eco_Segment", F.when(F.col("Pred_Green_Class").isNotNull(), fx.eco_label(
        "Pred_Green_Class", "Pred_Green_Score", round_first=False)))
    out = _nulls(out, Predicted_Churn="double") if churn is None else churn(out)
    return _nulls(out, Predicted_CLTV="double") if value is None else value(out)


def kmeans_step(k: int = 4, seed: int = 42) -> Step:
    """Segments by k-means on the transformed, weighted features of the table."""
    def step(df: DataFrame) -> DataFrame:
        vec, _ = segments.segment_input(df)
        return segments.kmeans_segments(vec, k, seed)[1].select(*df.columns, "KMeans_Segment")
    return step


def green_step(classifier: PipelineModel, regressor: PipelineModel, required: Sequence[str] = models.GREEN_NUMS) -> Step:
    """Green class and score of the rows with complete inputs (M18); the others get nulls."""
    def step(df: DataFrame) -> DataFrame:
        keep = df.columns
        complete = F.lit(True)
        for c in required:
            complete = complete & F.col(c).isNotNull()
        classed = classifier.transform(df.where(complete)).select(*keep, "Pred_Green_Class")
        scored = regressor.transform(classed).select(*keep, "Pred_Green_Class", "Pred_Green_Score")
        return scored.unionByName(_nulls(df.where(~complete), Pred_Green_Class="double", Pred_Green_Score="double"))
    return step


def churn_step(model: BoostedModel, required: Sequence[str]) -> Step:
    """Predicted churn class; null if an input column is missing."""
    return lambda df: models.score_guard(df, model, required, "Predicted_Churn",
                                         lambda s: fx.threshold("p1"))[0]


def value_step(model: BoostedModel, required: Sequence[str]) -> Step:
    """Predicted lifetime value, from a model of its ``log1p``."""
    return lambda df: models.score_guard(df, model, required, "Predicted_CLTV", lambda s: F.expm1("prediction"))[0]


def prediction_counts(scored: DataFrame, by: str = "Segment_Label", prediction: str = "Predicted_Churn") -> DataFrame:
    """How often each class is predicted in each group, and its share there in percent.
    Groups and rows without a prediction are left out."""
    counts = (scored.where(F.col(by).isNotNull() & F.col(prediction).isNotNull())
              .groupBy(by, prediction).agg(F.count(F.lit(1)).alias("customers")))
    totals = counts.groupBy(by).agg(F.sum("customers").alias("_all"))
    return (counts.join(totals, by).withColumn("share_pct", F.col("customers") * F.lit(100.0) / F.col("_all")).drop("_all"))
