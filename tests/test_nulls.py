"""Groups, bins, medians and CSV cells without a value."""

import pytest

from custspark import session
from custspark.operators import basket, clean, profile
from custspark.sources import io


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", 1)], "k string, f int")


def test_null_is_no_group(gaps):
    assert rows(profile.value_share(gaps, "k")) == [("a", 2, 66.67), ("b", 1, 33.33)]
    assert rows(profile.count_of_counts(gaps, "k")) == [(1, 1), (2, 1)]
    assert rows(profile.rate_by_category(gaps, "k", "f")) == [("a", 0.5, 2), ("b", 1.0, 1)]
    assert rows(profile.top_sums(gaps, "k", "f")) == [("a", 1), ("b", 1)]
    assert rows(profile.contingency(gaps, "k", "f", [0, 1])) == [("a", 1, 1), ("b", 0, 1)]
    assert rows(basket.reorder_rate(gaps, "k", "f")) == [("a", 0.5, 2), ("b", 1.0, 1)]


def test_empty_bins_are_listed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "x double")
    for right in (True, False):
        out = rows(profile.equal_width_bins(df, "x", 10, right))
        assert [r[0] for r in out] == list(range(1, 11)) and sum(r[1] for r in out) == 3
    assert rows(profile.equal_width_bins(df.where("x is null"), "x", 10)) == []


def test_half_median_and_mode(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "y"), (3, "y"), (4, "x")], "n bigint, s string")
    filled, actions = clean.auto_fill(df)
    assert sorted(r.n for r in filled.collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]
    assert rows(actions) == [("n", "median", "2.5"), ("s", "mode", "x")]


def test_csv_missing_tokens(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\ufeffid,v,w,t\n1,NA,1.5,a\n2,3,NaN,NA\n3,4,null,b\n")
    df = io.read_csv(spark, str(tmp_path / "x.csv"))
    assert df.dtypes == [("id", "bigint"), ("v", "bigint"), ("w", "double"), ("t", "string")]
    assert rows(df.na.fill(-1).na.fill("-")) == [(1, -1, 1.5, "a"), (2, 3, -1.0, "-"), (3, 4, -1.0, "b")]
    typed = io.read_csv(spark, str(tmp_path / "x.csv"), "id int, v double, w double, t string")
    assert typed.where("isnan(w) or isnan(v)").count() == 0 and typed.where("w is null").count() == 2


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_materialized_scan_is_pruned(spark):
    df = session.materialize(spark.range(10).selectExpr("id", "id * 2 as a", "id * 3 as b"), "t")
    plan = df.select("a")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:bigint>" in plan
