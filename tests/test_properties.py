"""Properties of the distributed building blocks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from custspark.operators import basket, metrics, ranking, sampling
from custspark.sources import adapters
from custspark.sources.tables import Tables

from .conftest import SF_SMALL


def test_row_number_matches_window(spark):
    df = spark.range(0, 500).select((F.col("id") % 7).alias("g"), F.col("id"), F.md5(F.col("id").cast("string")).alias("h"))
    a = ranking.row_number_distributed(df, ["h", "id"], strata=["g"], out="rn", num_partitions=5)
    w = Window.partitionBy("g").orderBy("h", "id")
    b = df.withColumn("rn", F.row_number().over(w))
    assert sorted(a.select("id", "rn").collect()) == sorted(b.select("id", "rn").collect())


def test_auc_counts_every_pair(spark):
    """Against all pairs: ties of scores, a score that a third of the rows share, null labels, one class only."""
    rng = np.random.default_rng(5)
    score = np.where(rng.random(600) < 0.33, 0.5, np.round(rng.random(600), 2))
    label = (rng.random(600) < 0.2 + 0.5 * score).astype(float)
    df = spark.createDataFrame([(float(s), float(y)) for s, y in zip(score, label)], "s double, y double").repartition(4)
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    row = metrics.roc_auc(df, "y", "s").first()
    assert abs(row["auc"] - want) < 1e-12 and (row["positives"], row["negatives"]) == (len(pos), len(neg))
    alike = metrics.roc_auc(df.withColumn("s", F.lit(1.0)), "y", "s").first()
    assert alike["auc"] == 0.5


def test_split_disjoint_complete_stable(spark):
    df = spark.range(0, 400).select(F.col("id").alias("Customer_ID"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s1 = sampling.stratified_split(df, "Customer_ID", "y", 0.2)
    s2 = sampling.stratified_split(df.repartition(7), "Customer_ID", "y", 0.2)
    r1 = {r[0]: r[1] for r in s1.select("Customer_ID", "split").collect()}
    r2 = {r[0]: r[1] for r in s2.select("Customer_ID", "split").collect()}
    assert r1 == r2 and len(r1) == 400
    test = [k for k, v in r1.items() if v == "test"]
    assert len(test) == round(0.2 * 134) + round(0.2 * 266)


def test_rule_lift_symmetric_support_antitone(spark):
    t = Tables(spark, SF_SMALL)
    b = basket.baskets(adapters.basket_lines(t))
    its = basket.frequent_itemsets(b, 0.05)
    sup = {tuple(r["items"]): r["support"] for r in its.collect()}
    for items, s in sup.items():
        for i in range(len(items)):
            sub = items[:i] + items[i + 1:]
            if sub:
                assert sup[sub] >= s
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): r["lift"]
             for r in basket.association_rules(its).collect()}
    for (a, c), lift in rules.items():
        assert rules[(c, a)] == pytest.approx(lift)


def test_fingerprint_order_insensitive(spark):
    from custspark.sources.io import fingerprint
    df = spark.range(0, 100).select(F.col("id"), (F.col("id") * 3).alias("x"))
    assert fingerprint(df).first() == fingerprint(df.orderBy(F.desc("id")).repartition(3)).first()


@pytest.mark.parametrize("shape", ["ties at the minimum", "wide", "few"])
def test_exact_quantiles(spark, shape):
    """Ranks on ties at 0 with minimum 0, values 300 orders of magnitude apart, single values; NaN and null are no values."""
    from custspark.operators.quantiles import quantiles
    rng = np.random.default_rng(7)
    vals = {"ties at the minimum": (rng.random(4000) > 0.75).astype(float), "few": np.array([3.0, 1.0]),
            "wide": np.concatenate([rng.random(500), rng.random(500) * 1e300, -rng.random(300)])}[shape]
    df = spark.createDataFrame([(float(v), None) for v in vals] + [(float("nan"), None), (None, None)], "x double, y double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles(df, ["x", "y"], probs)
    assert np.allclose(got["x"], np.quantile(vals, probs), rtol=1e-12, atol=0) and got["y"] == [None] * len(probs)


def test_quantiles_read_back_one_row_a_rank(spark):
    from custspark.operators import quantiles as q
    df = spark.range(200_000).selectExpr("cast(id % 4 = 0 as double) x")
    assert q.quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"] == [0.0, 0.0, 0.25]
    summary = q.column_summary(df, ["x"])
    assert q.order_statistics(df, {("x", r): (0.0, 1.0) for r in (0, 99_999, 150_000)}, summary) == {("x", 0): 0.0, ("x", 99_999): 0.0, ("x", 150_000): 1.0}


def test_model_roundtrip_and_score_guard(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import DecisionTreeRegressor
    from pyspark.ml.feature import VectorAssembler
    from custspark.operators import models
    from custspark.sources import io
    df = spark.range(0, 60).select(F.col("id").alias("Customer_ID"), (F.col("id") % 7).cast("double").alias("a"),
                                   (F.col("id") * 2.0).alias("y"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"),
                            DecisionTreeRegressor(labelCol="y", maxDepth=3)])
    model = pipe.fit(df)
    path = str(tmp_path / "m")
    io.save_model(model, path)
    back = io.load_pipeline_model(path)
    assert back.transform(df).select("prediction").collect() == model.transform(df).select("prediction").collect()
    scored, notice = models.score_guard(df.drop("a"), back, ["a"], "pred")
    assert notice.count() == 1 and scored.where(F.col("pred").isNotNull()).count() == 0
    scored, notice = models.score_guard(df, back, ["a"], "pred")
    assert notice.count() == 0 and scored.where(F.col("pred").isNull()).count() == 0


def test_csv_reader_bom_and_null_tokens(spark, tmp_path):
    from custspark.sources import io
    p = tmp_path / "x.csv"
    p.write_text("\ufeffid,name\n1,NA\n2,bob\n", encoding="utf-8")
    df = io.read_csv(spark, str(p))
    assert df.columns == ["id", "name"]
    assert sorted(df.collect(), key=lambda r: r[0]) == [(1, None), (2, "bob")]
