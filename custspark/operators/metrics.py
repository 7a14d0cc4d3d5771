"""Model quality as DataFrames.

Every metric is a grouped count or one aggregate, so it can be checked in
SQL and runs on any number of scored rows.  The exact ROC AUC groups rows
by distinct score and needs running sums over the scores; those are taken in
stretches of the score, never in a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import shuffle_width


def confusion(df: DataFrame, label: str, pred: str, labels=(0.0, 1.0)) -> DataFrame:
    """``(label, prediction, count)`` over the full label grid; absent
    pairs are 0.  The grid is built by exploding the (known, small) label
    list, then left-joined with the grouped counts."""
    lab = F.array(*[F.lit(float(v)) for v in labels])
    grid = (df.sparkSession.range(1).select(F.explode(lab).alias("label"))
            .select("label", F.explode(lab).alias("prediction")))
    counts = (df.select(F.col(label).cast("double").alias("label"), F.col(pred).cast("double").alias("prediction"))
              .groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count")))
    return grid.join(counts, ["label", "prediction"], "left").na.fill(0, ["count"])


def classification_report(df: DataFrame, label: str, pred: str, labels=(0.0, 1.0)) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro
    and weighted averages (rows named as in the usual report).  0/0 is 0."""
    cm = confusion(df, label, pred, labels)
    per = cm.groupBy(F.col("label").alias("cls")).agg(
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)).alias("tp"),
        F.sum("count").alias("support"))
    predicted = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("count").alias("pred_n"))
    per = per.join(predicted, "cls")
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumns({"precision": prec, "recall": rec})
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      F.lit(2.0) * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    rows = per.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                      F.col("support").cast("long").alias("support"))
    total = per.agg(F.sum("support")).scalar()
    acc = per.agg(F.sum("tp")).scalar() / total
    summary = per.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").cast("long").alias("n"))
    extra = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")))).alias("r")
    ).select("r.*")
    return rows.unionByName(extra)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC (ties count one half).  Rows are counted by distinct
    score; sketched quantiles of the score cut its range into as many stretches as a shuffle has
    partitions, negatives are summed up in order inside each stretch, and the stretches (a row each) are
    put together.  Nothing is written and no task holds more than a stretch."""
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
    n = shuffle_width(df.sparkSession)
    cuts = sorted(set(rows.agg(F.percentile_approx("s", F.lit([k / n for k in range(1, n)] or [0.5]), 1000)).first()[0] or []))
    by_score = rows.groupBy("s").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"),
                                     F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"))
    stretch = F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c <= F.col("s"))) if cuts else F.lit(0)
    before = Window.partitionBy("stretch").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before), F.lit(0))
    parts = (by_score.withColumn("stretch", stretch).withColumn("below", below)
             .groupBy("stretch").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") * F.lit(0.5))).alias("won"),
                                     F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    earlier = F.coalesce(F.sum("neg").over(Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("earlier", earlier).agg(
        (F.sum(F.col("won") + F.col("pos") * F.col("earlier")) / (F.sum("pos") * F.sum("neg"))).alias("auc"),
        F.sum("pos").cast("long").alias("positives"), F.sum("neg").cast("long").alias("negatives"))


def regression_report(df: DataFrame, label: str, pred: str, log_target: bool = False) -> DataFrame:
    """R^2 and MAE in one aggregate (the total sum of squares is
    n * var_pop(y), Spark's stable online form); with ``log_target`` the
    figures are given on the log1p scale and on the original scale
    (``expm1`` of both)."""
    def stats(y, p, tag):
        return [(F.lit(1.0) - F.sum((y - p) * (y - p)) / (F.count(y) * F.var_pop(y))).alias(f"r2{tag}"),
                F.avg(F.abs(y - p)).alias(f"mae{tag}")]
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    if not log_target:
        return df.agg(*stats(y, p, ""))
    return df.agg(*stats(y, p, "_log"), *stats(F.expm1(y), F.expm1(p), ""))
