"""Preparation stages saved with a model, and the Euclidean silhouette."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from custspark.operators import prep, segments


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.pareto(2.0)), float(rng.standard_normal()), 4.0, None if i % 7 == 0 else float(i % 5)) for i in range(500)]
    return spark.createDataFrame(rows, "id long, a double, b double, flat double, gaps double").withColumn(
        "gaps", F.when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col("gaps"))).repartition(3)


COLS = ["a", "b", "flat", "gaps"]


def names(s):
    return [f"{c}{s}" for c in COLS]


def test_stages_saved_and_loaded_give_the_same(spark, df, tmp_path):
    stages = [prep.MedianFill(inputCols=COLS, outputCols=names("_f")), prep.ExactRobustScaler(inputCols=names("_f"), outputCols=names("_r")),
              prep.YeoJohnson(inputCols=names("_r"), outputCols=names("_y")), prep.FeatureWeights(inputCols=names("_y"), outputCols=names("_w"), weights=[1.0, 2.0, 3.0, 4.0]),
              VectorAssembler(inputCols=names("_w"), outputCol="features")]
    pipe = Pipeline(stages=stages)
    pipe.write().overwrite().save(str(tmp_path / "pipe"))
    model = Pipeline.load(str(tmp_path / "pipe")).fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    got = {r["id"]: r for r in model.transform(df).collect()}
    assert {i: repr(r) for i, r in got.items()} == {r["id"]: repr(r) for r in back.transform(df).collect()} and len(got) == 500
    pdf = df.toPandas().set_index("id").sort_index()
    filled = pdf["gaps"].fillna(pdf["gaps"].median())
    q1, med, q3 = filled.quantile([0.25, 0.5, 0.75])
    for i in pdf.index:
        assert got[i]["gaps_f"] == filled[i] and got[i]["gaps_r"] == pytest.approx((filled[i] - med) / ((q3 - q1) or 1.0))
        assert got[i]["flat_r"] == 0.0 and got[i]["flat_y"] == 0.0
    y = np.array([got[i]["a_y"] for i in pdf.index])
    assert abs(y.mean()) < 1e-9 and abs(y.std() - 1) < 1e-9
    assert [got[3]["a_w"], got[3]["b_w"]] == [got[3]["a_y"], 2.0 * got[3]["b_y"]]
    # rows that the fit has not seen, and columns without values
    new = spark.createDataFrame([(1, None, 1e6, None, None)], df.schema)
    assert [r["features"].size for r in back.transform(new).collect()] == [4]
    none = prep.MedianFill(inputCols=["a"], outputCols=["x"]).fit(df.where("false"))
    assert none.transform(new).first()["x"] == 0.0


def test_segmentation_saved_as_one_object(spark, df, tmp_path):
    data = df.toDF("Customer_ID", *segments.SEGMENT_FEATURES, "more")
    model = segments.segmentation_pipeline(3).fit(data)
    model.write().overwrite().save(str(tmp_path / "m"))
    rows = lambda m: sorted(m.transform(data).select("Customer_ID", "KMeans_Segment").collect())
    assert rows(model) == rows(PipelineModel.load(str(tmp_path / "m")))


@pytest.mark.parametrize("rows,anchors", [(16_384, 2_048), (90, 4)])
def test_euclidean_silhouette(spark, df, monkeypatch, rows, anchors):
    monkeypatch.setattr(segments, "SILHOUETTE_ROWS", rows)
    monkeypatch.setattr(segments, "SILHOUETTE_ANCHORS", anchors)
    data = df.withColumn("c", F.when(F.col("id") == 20, 9).when(F.col("id") == 21, None).otherwise(F.col("id") % 3))
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)
    got = {r["id"]: r for r in segments.euclidean_silhouette(vec, F.col("id") % 10 == 0, "id", "c").collect()}
    pdf = data.toPandas().dropna(subset=["c"]).set_index("id")
    x, c = pdf[["a", "b"]].to_numpy(), pdf["c"].to_numpy()
    assert set(got) == {i for i in pdf.index if i % 10 == 0}
    for k, i in enumerate(pdf.index):
        if i % 10:
            continue
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        own = c == c[k]
        b = min(d[c == o].mean() for o in set(c) if o != c[k])
        if own.sum() == 1:
            assert got[i]["a"] is None and got[i]["silhouette"] == 0.0
            continue
        a = d[own].sum() / (own.sum() - 1)
        assert (got[i]["a"], got[i]["b"]) == (pytest.approx(a), pytest.approx(b)) and got[i]["silhouette"] == pytest.approx((b - a) / max(a, b))


def test_silhouette_of_one_cluster_and_of_nothing(spark, df):
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.withColumn("c", F.lit(1)))
    assert {r["silhouette"] for r in segments.euclidean_silhouette(vec, F.col("id") < 5, "id", "c").collect()} == {None}
    assert segments.euclidean_silhouette(vec, F.lit(False), "id", "c").count() == 0
    assert segments.euclidean_silhouette(vec.where("false"), F.lit(True), "id", "c").count() == 0
