"""Hand-made rows for the semantic traps (FIXTURES section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from custspark.functions import scalar as fx
from custspark.operators import basket, clean, metrics, profile, segments, whatif


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert col(df.select(fx.round_half_even("x").alias("r")), "r") == [0, 2, 2, 0]


def test_zero_pad(spark):
    df = spark.createDataFrame([(7,), (12345,)], "x long")
    assert col(df.select(fx.zero_pad("x", 4).alias("p")), "p") == ["0007", "12345"]


def test_numeric_coerce(spark):
    df = spark.createDataFrame([("12h",), ("3.5",), ("",), (None,), ("-4",)], "x string")
    assert col(df.select(fx.numeric_coerce("x").alias("v")), "v") == [12.0, 3.5, None, None, 4.0]


def test_median_fill(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (10.0,), (11.0,)], "x double")
    assert sorted(col(clean.fill_median(df, ["x"]), "x")) == [1.0, 2.0, 6.0, 10.0, 11.0]


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (1, 1), (1, 1)], "k int, x int")
    assert df.groupBy("k").agg(F.mode("x", True).alias("m")).first()["m"] == 1


def test_skew_bias_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (10.0,), (None,)], "x double")
    s = profile.skew_profile(df, ["x"]).first()
    assert s["skew"] == pytest.approx(1.86179517, abs=1e-7)


def test_quartiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (10.0,)], "x double")
    p = profile.numeric_profile(df, ["x"]).first()
    assert p["q25"] == pytest.approx(1.75) and p["median"] == pytest.approx(2.25)


def test_bins_max_in_last(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    for right in (True, False):
        bins = {r["bin"]: r["count"] for r in profile.equal_width_bins(df, "x", 10, right).collect()}
        assert max(bins) == 10 and sum(bins.values()) == 11


def test_preferred_department_tie(spark):
    from custspark.plans.customer360 import preferred_department
    orders = spark.createDataFrame([(1, 10), (1, 11)], "Customer_ID long, Order_ID long")
    op = spark.createDataFrame([(10, 5), (10, 5), (11, 3), (11, 3)], "Order_ID long, Product_ID long")
    prods = spark.createDataFrame([(5, 5), (3, 3)], "Product_ID long, Department_ID int")
    depts = spark.createDataFrame([(5, "five"), (3, "three")], "Department_ID int, Department_Name string")
    r = preferred_department(orders, op, prods, depts).first()
    assert r["Preferred_Order_Category"] == 3


def _baskets(spark, with_empty=True):
    rows = [(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a", "c"])]
    if with_empty:
        rows.append((4, []))
    return spark.createDataFrame(rows, "Order_ID long, items array<string>")


def test_itemsets_and_rules_with_empty_basket(spark):
    its = basket.frequent_itemsets(_baskets(spark), 0.2)
    got = {tuple(r["items"]): r["freq"] for r in its.collect()}
    assert got == {("a",): 3, ("b",): 2, ("c",): 2, ("a", "b"): 2, ("a", "c"): 2, ("b", "c"): 1,
                   ("a", "b", "c"): 1}
    rules = basket.association_rules(its).collect()
    r = {(tuple(x["antecedents"]), tuple(x["consequents"])): x for x in rules}
    assert r[(("b",), ("a",))]["confidence"] == pytest.approx(1.0)
    assert r[(("b",), ("a",))]["lift"] == pytest.approx(4 / 3)
    assert r[(("a",), ("b", "c"))]["confidence"] == pytest.approx(1 / 3)
    assert r[(("a",), ("b", "c"))]["lift"] == pytest.approx(4 / 3)
    assert math.isinf(r[(("b",), ("a",))]["conviction"])


def test_rules_without_empty_basket(spark):
    its = basket.frequent_itemsets(_baskets(spark, False), 0.2)
    r = {(tuple(x["antecedents"]), tuple(x["consequents"])): x for x in basket.association_rules(its).collect()}
    assert r[(("b",), ("a",))]["lift"] == pytest.approx(1.0)


def test_empty_rules_keep_schema(spark):
    lines = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "Order_ID long, Department_Name string")
    rules, _, _ = basket.mine_rules(lines, 0.05, 0.4, 1.3)
    assert rules.count() == 0 and set(basket.RULE_COLUMNS) <= set(rules.columns)


def test_unseen_category_zero_vector(spark):
    from pyspark.ml import Pipeline
    from custspark.operators.features import one_hot_stages
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    model = Pipeline(stages=one_hot_stages(["c"])).fit(train)
    test = spark.createDataFrame([("z",), (None,)], "c string")
    vecs = [r[0] for r in model.transform(test).select("_oh_c").collect()]
    assert all(v.numNonzeros() == 0 for v in vecs)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (7.0,)], "x double")
    assert col(df.select(fx.clip("x", 0, 5).alias("c")), "c") == [None, 5.0]


def test_chi_square_yates(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 4 + [("b", "y")] * 9
    df = spark.createDataFrame(rows, "a string, b string")
    r = profile.chi_square(df, "a", "b").first()
    assert r["statistic"] == pytest.approx(2.2974, abs=1e-4) and r["dof"] == 1
    assert 0 < r["p_value"] < 1


def test_eco_strength_golden(spark):
    x = spark.createDataFrame([("s", 118, 9, 108)], "Segment_Label string, Eco_Conscious long, Eco_Warrior long, Low_Interest long")
    assert segments.eco_strength(x).first()["Eco_Strength_Pct"] == pytest.approx(21.98581560283688, abs=1e-9)


def test_eco_label_edges(spark):
    df = spark.createDataFrame([(1, 0.7), (1, 0.4), (1, 0.399), (0, 0.9)], "k int, s double")
    assert col(df.select(fx.eco_label("k", "s", round_first=False).alias("e")), "e") == [
        "Eco_Warrior", "Eco_Conscious", "Low_Interest", "Low_Interest"]
    r = spark.createDataFrame([(1, 0.696)], "k int, s double")
    assert col(r.select(fx.eco_label("k", "s").alias("e")), "e") == ["Eco_Warrior"]
    assert col(r.select(fx.eco_label("k", "s", round_first=False).alias("e")), "e") == ["Eco_Conscious"]


def test_outliers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (100.0,)], "x double")
    assert profile.iqr_outliers(df, ["x"]).first()["outliers"] == 1


def test_cashback_lever(spark):
    df = spark.createDataFrame([(1, 101.0, 3, 50, 10)], "Customer_ID long, Average_Cash_Back double, "
                               "Satisfaction_Score long, Loyalty_Engagement_Score long, Days_Since_Last_Order long")
    r = whatif.cashback_lever(df, 10).first()
    assert (r["Average_Cash_Back"], r["Satisfaction_Score"], r["Loyalty_Engagement_Score"],
            r["Days_Since_Last_Order"]) == (111, 4, 50, 6)


def test_levers_zero_identity(spark):
    df = spark.createDataFrame([(1, 101.0, 3)], "Customer_ID long, Average_Cash_Back double, Satisfaction_Score long")
    assert whatif.apply_levers(df, whatif.Levers()).collect() == df.collect()


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(0.625)
