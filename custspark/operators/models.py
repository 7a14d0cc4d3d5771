"""Churn, value and green-purchase models.

Churn and value models are boosted trees (:mod:`.boosting`), which also train
all settings and folds of a search at once; the green models are Spark's
single decision trees on the pipeline of :mod:`.features`.  A search samples a
seeded subset of the grid and cross-validates with stratified, hash-made
folds, so folds are reproducible on any partitioning.
"""

from __future__ import annotations

import itertools
import random
import statistics
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .boosting import BoostedModel, Setting
from .features import feature_pipeline
from .ranking import row_number_distributed

# Model inputs (categorical, numeric, target).
CHURN_CATS = ["Preferred_Login_Device", "Preferred_Payment_Mode", "Marital_Status"]
CHURN_NUMS = ["City_Tier", "Total_Devices_Registered", "Satisfaction_Score", "Complain_Count_In_Last_Month",
              "Days_Since_Last_Order", "Average_Cash_Back"]
CLTV_CATS = ["Marital_Status", "Customer_Gender", "Customer_Residence_Type", "Customer_Qualification",
             "Customer_Income", "Total_Subscriptions", "Membership_Type"]
CLTV_NUMS = ["Loyalty_Engagement_Score"]
GREEN_CATS = ["Referral_Source"]
GREEN_NUMS = ["Cultural_Eco_Alignment", "Emotional_Guilt_Score", "Emotional_Pride_Score", "Social_Influence_Score",
              "Green_Knowledge_Level", "Time_Spent_on_Green_Products", "Clicks_on_Green_Products",
              "Previous_Green_Purchases"]

# What the searches draw from (trees, depth, step, share of rows and of columns a tree sees).
CHURN_GRID = {"trees": [300, 500, 700], "depth": [4, 6, 8], "step": [0.01, 0.02, 0.05],
              "rows": [0.7, 0.8, 0.9], "columns": [0.7, 0.8]}
VALUE_GRID = {"trees": [500, 1000, 1500], "depth": [3, 5, 7], "step": [0.01, 0.05, 0.1],
              "rows": [0.7, 0.8, 0.9], "columns": [0.7, 0.8, 0.9]}


@dataclass
class ModelSpec:
    cats: Sequence[str]
    nums: Sequence[str]
    label: str


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """A28 as a weight column: positives weigh sqrt(neg/pos) (the
    ``scale_pos_weight`` of the original), negatives 1."""
    ratio = df.agg(F.sqrt(F.try_divide(F.count_if(F.col(label) != 1).cast("double"),
                                       F.count_if(F.col(label) == 1).cast("double")))).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, F.coalesce(ratio, F.lit(1.0))).otherwise(F.lit(1.0)))


#: One model without a search: the least trees of the grids, at steps and depths from them.
CHURN_SETTING = Setting(trees=300, depth=4, step=0.05, rows=0.8, columns=0.8)
VALUE_SETTING = Setting(trees=500, depth=3, step=0.05, rows=0.8, columns=0.8)


def churn_model(df: DataFrame, spec: ModelSpec, setting: Setting = CHURN_SETTING, id_col: str = "Customer_ID") -> BoostedModel:
    """Churn classifier, rows weighed by the column ``weight``."""
    return boosting.fit(df, spec.cats, spec.nums, spec.label, id_col, setting, "logistic", weight_col="weight")


def value_model(df: DataFrame, spec: ModelSpec, setting: Setting = VALUE_SETTING, id_col: str = "Customer_ID") -> BoostedModel:
    """Lifetime-value regressor on the log1p target (the label column is expected to hold ``log1p(value)``)."""
    return boosting.fit(df, spec.cats, spec.nums, spec.label, id_col, setting, "squared")


def green_pipelines(cats=GREEN_CATS, nums=GREEN_NUMS, class_label: str = "Green_Purchase_Made",
                    score_label: str = "Green_Consumption_Score") -> tuple[Pipeline, Pipeline]:
    """Depth-5 decision tree classifier (>= 10 rows per leaf) and
    depth-5 regression tree, without scaling."""
    prep = feature_pipeline(cats, nums, scale=False).getStages()
    clf = DecisionTreeClassifier(labelCol=class_label, featuresCol="features", maxDepth=5,
                                 minInstancesPerNode=10, seed=42, probabilityCol="green_probability",
                                 rawPredictionCol="green_raw", predictionCol="Pred_Green_Class")
    reg = DecisionTreeRegressor(labelCol=score_label, featuresCol="features", maxDepth=5, seed=42,
                                predictionCol="Pred_Green_Score")
    return Pipeline(stages=prep + [clf]), Pipeline(stages=list(prep) + [reg])


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Fold ids 0..k-1 dealt round-robin within each class in hash order, so
    every fold keeps the class shares (``StratifiedKFold``-like)."""
    ranked = row_number_distributed(df, [F.md5(F.col(id_col).cast("string")), F.col(id_col)],
                                    strata=[label], out="_rn")
    return ranked.withColumn(out, ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def draw_settings(grid: dict[str, Sequence], n_iter: int, seed: int = 42) -> list[Setting]:
    """``n_iter`` different settings drawn (seeded) from the whole grid, or all of a smaller grid."""
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return [Setting(**chosen) for chosen in random.Random(seed).sample(every, min(n_iter, len(every)))]


def search_table(spark: SparkSession, settings: Sequence[Setting], found: Sequence[Sequence[float]]) -> DataFrame:
    """``(setting, params, mean_metric, std_metric)``, a row a setting."""
    rows = [(i, f"trees={s.trees}, depth={s.depth}, step={s.step}, rows={s.rows}, columns={s.columns}", statistics.fmean(m), statistics.pstdev(m))
            for i, (s, m) in enumerate(zip(settings, found)) if m]
    return spark.createDataFrame(rows, "setting int, params string, mean_metric double, std_metric double")


def churn_search(train: DataFrame, spec: ModelSpec, id_col: str = "Customer_ID", grid: dict | None = None,
                 n_iter: int = 10, k: int = 5, seed: int = 42) -> tuple[Setting, DataFrame]:
    """Churn search by the F1 of class 1, on folds that keep the class shares; the best setting and the table of all."""
    df = stratified_folds(train, id_col, spec.label, k)
    settings = draw_settings(grid or CHURN_GRID, n_iter, seed)
    found = boosting.search(df, spec.cats, spec.nums, spec.label, id_col, settings, "logistic", k, weight_col="weight")
    best = max(range(len(settings)), key=lambda i: statistics.fmean(found[i]))
    return settings[best], search_table(train.sparkSession, settings, found)


def value_search(train: DataFrame, spec: ModelSpec, id_col: str = "Customer_ID", grid: dict | None = None,
                 n_iter: int = 15, k: int = 5, seed: int = 42) -> tuple[Setting, DataFrame]:
    """Value search by the mean absolute error of the log1p target (the least is best); as above."""
    numbered = row_number_distributed(train, [F.md5(F.col(id_col).cast("string")), F.col(id_col)], out="_rn")
    df = numbered.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")
    settings = draw_settings(grid or VALUE_GRID, n_iter, seed)
    found = boosting.search(df, spec.cats, spec.nums, spec.label, id_col, settings, "squared", k)
    best = min(range(len(settings)), key=lambda i: statistics.fmean(found[i]))
    return settings[best], search_table(train.sparkSession, settings, found)


def feature_slot_names(model: PipelineModel, cats: Sequence[str], nums: Sequence[str]) -> list[str]:
    """Names of the assembled feature slots: ``column=level`` for every kept
    one-hot slot (indexer labels in order; the dropped last slot is the
    unseen bucket), then the numeric columns."""
    from pyspark.ml.feature import StringIndexerModel
    labels = {st.getInputCol(): list(st.labels) for st in model.stages if isinstance(st, StringIndexerModel)}
    names = []
    for c in cats:
        names += [f"{c}={v}" for v in labels.get(c, [])]
    return names + list(nums)


def score_guard(df: DataFrame, model: PipelineModel, required: Sequence[str], out: str,
                extract=None) -> tuple[DataFrame, DataFrame]:
    """Score only when every required column is present, otherwise add
    a NULL column; returns ``(frame, notices)`` where notices lists the
    missing columns (a schema check, no job)."""
    missing = [c for c in required if c not in df.columns]
    spark = df.sparkSession
    if missing:
        notice = spark.createDataFrame([(out, ", ".join(missing))], "model string, missing_columns string")
        return df.withColumn(out, F.lit(None).cast("double")), notice
    scored = model.transform(df)
    value = extract(scored) if extract is not None else F.col("prediction")
    keep = df.columns
    return scored.select(*keep, value.alias(out)), spark.createDataFrame([], "model string, missing_columns string")


def score_valid_rows(df: DataFrame, model: PipelineModel, required: Sequence[str], key: str,
                     outputs: dict) -> tuple[DataFrame, DataFrame]:
    """Rows with every required value present are scored, the
    results are joined back by key (others get NULL); the second frame
    counts valid and skipped rows."""
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    valid = df.where(complete)
    scored = model.transform(valid).select(key, *[e.alias(n) for n, e in outputs.items()])
    out = df.join(scored, key, "left")
    counts = df.agg(F.count_if(complete).alias("scored_rows"), F.count_if(~complete).alias("skipped_rows"))
    return out, counts
