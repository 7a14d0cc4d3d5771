"""What-if levers on a scored customer table.

A scenario is four lever percentages.  The levers rewrite feature columns
row by row (pure column expressions, in the fixed order cashback, support,
price, subscription, each on the rounded output of the one before), the
changed table is re-scored, and the before/after figures become one KPI
row and a table of findings.  Nothing is collected: the scenario
constants are Python numbers, every data-dependent figure is a Spark
aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, is_text_one, pct_change, threshold
from .ranking import row_number_distributed

Scorer = Callable[[DataFrame], DataFrame]  # adds _churn_prob, _cltv

# Columns a scenario reads (the required feature list of the
# simulator input) and the baseline prediction columns.
REQUIRED_FEATURES = [
    "Preferred_Login_Device", "City_Tier", "Preferred_Payment_Mode",
    "Hours_Spend_On_Website", "Total_Devices_Registered", "Satisfaction_Score",
    "Marital_Status", "Complain_Count_In_Last_Month", "Order_Amount_Hike_From_Last_Year",
    "Days_Since_Last_Order", "Average_Cash_Back",
    "Customer_Gender", "Customer_Residence_Type", "Customer_Qualification",
    "Customer_Income", "Total_Subscriptions", "Membership_Type",
    "Loyalty_Engagement_Score", "Customer_Age", "Total_Amount_Spent",
    "Total_Returns", "Total_Orders_This_Month",
]
BASELINE_COLUMNS = ["Predicted_Churn", "Predicted_CLTV"]

SAT, LOY, DAYS = "Satisfaction_Score", "Loyalty_Engagement_Score", "Days_Since_Last_Order"


@dataclass(frozen=True)
class Levers:
    """Lever percentages; ranges on the original page: cashback -20..50,
    price (marketing) -10..30, support 0..50, subscription 0..50."""
    cashback: float = 0
    support: float = 0
    price: float = 0
    subscription: float = 0

    def is_baseline(self) -> bool:
        return self.cashback == 0 and self.support == 0 and self.price == 0 and self.subscription == 0


def _r(c: Column) -> Column:
    """``.round().astype(int64)`` - half-even."""
    return F.bround(c, 0).cast("long")


def _f(name: str) -> Column:
    return F.col(name).cast("double")


def require_columns(df: DataFrame, cols=REQUIRED_FEATURES + BASELINE_COLUMNS) -> None:
    """Raise with the list of absent columns (no Spark job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"dataset missing required columns: {', '.join(missing)}")


def cashback_lever(df: DataFrame, c: float) -> DataFrame:
    """C1."""
    if c == 0:
        return df
    out = {"Average_Cash_Back": _r(clip(_f("Average_Cash_Back") * F.lit(1 + c / 100), lower=0))}
    if c > 0:
        out[SAT] = _r(clip(_f(SAT) + F.lit(c * 0.05), upper=5))
        out[LOY] = _r(_f(LOY) + F.lit(c * 0.03))
        out[DAYS] = _r(clip(_f(DAYS) * F.lit(1 - min(c * 0.04, 0.6)), lower=0))
    else:
        out[SAT] = _r(clip(_f(SAT) - F.lit(abs(c) * 0.04), lower=1))
        out[LOY] = _r(clip(_f(LOY) - F.lit(abs(c) * 0.025), lower=0))
        out[DAYS] = _r(_f(DAYS) * F.lit(1 + min(abs(c) * 0.03, 0.4)))
    return df.withColumns(out)


def support_lever(df: DataFrame, s: float) -> DataFrame:
    """C2 (only positive values act)."""
    if s <= 0:
        return df
    return df.withColumns({
        "Complain_Count_In_Last_Month": _r(clip(_f("Complain_Count_In_Last_Month") * F.lit(1 - s / 100), lower=0)),
        SAT: _r(clip(_f(SAT) + F.lit(s * 0.04), upper=5)),
        LOY: _r(_f(LOY) + F.lit(s * 0.025)),
        DAYS: _r(clip(_f(DAYS) * F.lit(1 - min(s * 0.02, 0.3)), lower=0)),
    })


def price_lever(df: DataFrame, p: float) -> DataFrame:
    """C3 (the marketing slider feeds this lever)."""
    if p == 0:
        return df
    df = df.withColumn("Total_Amount_Spent", _r(clip(_f("Total_Amount_Spent") * F.lit(1 + p / 100), lower=0)))
    if p > 0:
        return df.withColumns({
            "Order_Amount_Hike_From_Last_Year": _r(_f("Order_Amount_Hike_From_Last_Year") + F.lit(p * 0.5)),
            DAYS: _r(_f(DAYS) * F.lit(1 + min(p * 0.08, 0.7))),
            SAT: _r(clip(_f(SAT) - F.lit(p * 0.03), lower=1)),
            LOY: _r(clip(_f(LOY) - F.lit(p * 0.02), lower=0)),
        })
    return df.withColumns({
        DAYS: _r(clip(_f(DAYS) * F.lit(1 - min(abs(p) * 0.05, 0.4)), lower=0)),
        SAT: _r(clip(_f(SAT) + F.lit(abs(p) * 0.02), upper=5)),
        LOY: _r(_f(LOY) + F.lit(abs(p) * 0.015)),
    })


def subscription_lever(df: DataFrame, u: float, id_col: str = "Customer_ID",
                       original: DataFrame | None = None) -> DataFrame:
    """C4: ``floor(eligible * u / 100)`` single-subscription rows, the first
    in hash order, take the (smallest) multi-subscription value of the
    original table, or ``'More than 1'`` if it has none; afterwards every
    multi-subscription row gains loyalty, and all rows gain satisfaction."""
    if u <= 0:
        return df
    original = original if original is not None else df
    subs = "Total_Subscriptions"
    single = is_text_one(subs)
    eligible = df.agg(F.count_if(single)).scalar()
    n_convert = F.least(F.floor(eligible * F.lit(u / 100)), eligible)
    replacement = F.coalesce(
        original.where(~is_text_one(subs)).agg(F.min(F.col(subs).cast("string"))).scalar(),
        F.lit("More than 1"))
    ranked = row_number_distributed(df.where(single).select(id_col),
                                    [F.md5(F.col(id_col).cast("string")), F.col(id_col)], out="_rn")
    chosen = ranked.where(F.col("_rn") <= n_convert).select(id_col, F.lit(True).alias("_convert"))
    out = (df.join(chosen, id_col, "left")
           .withColumn(subs, F.when(F.col("_convert"), replacement).otherwise(F.col(subs).cast("string")))
           .drop("_convert"))
    multi = ~is_text_one(subs)
    return out.withColumns({
        LOY: _r(F.when(multi, _f(LOY) + F.lit(u * 0.03)).otherwise(_f(LOY))),
        SAT: _r(clip(_f(SAT) + F.lit(u * 0.02), upper=5)),
    })


def apply_levers(df: DataFrame, levers: Levers, id_col: str = "Customer_ID") -> DataFrame:
    """C1-C4 in the fixed order."""
    out = cashback_lever(df, levers.cashback)
    out = support_lever(out, levers.support)
    out = price_lever(out, levers.price)
    return subscription_lever(out, levers.subscription, id_col, original=df)


def linear_scorer(df: DataFrame) -> DataFrame:
    """A closed-form stand-in for the two trained models (same inputs, no
    learner): churn risk grows with complaints and recency and falls with
    satisfaction and cash back; value grows with spend, loyalty and
    multi-subscription status.  Used for exact SQL checks of the what-if
    arithmetic."""
    p = (F.lit(0.15) + F.lit(0.2) * _f("Complain_Count_In_Last_Month") + F.lit(0.001) * _f(DAYS)
         - F.lit(0.05) * _f(SAT) - F.lit(0.001) * _f("Average_Cash_Back"))
    v = (F.lit(0.05) * _f("Total_Amount_Spent") + F.lit(0.5) * _f(LOY)
         + F.when(is_text_one("Total_Subscriptions"), F.lit(0.0)).otherwise(F.lit(500.0)))
    return df.withColumns({"_churn_prob": clip(p, 0.0, 1.0), "_cltv": v})


def model_scorer(churn_model, cltv_model) -> Scorer:
    """Two fitted models: churn probability of class 1, and
    the value model's log prediction mapped back with ``expm1``."""
    def score(df: DataFrame) -> DataFrame:
        keep = df.columns
        c = churn_model.transform(df).select(*keep, F.col("p1").alias("_churn_prob"))
        v = cltv_model.transform(c).select(*keep, "_churn_prob", F.expm1("prediction").alias("_cltv"))
        return v
    return score


def with_baseline(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Scored customers: ``Predicted_Churn`` (0/1) and ``Predicted_CLTV``."""
    s = scorer(df)
    return s.withColumns({"Predicted_Churn": threshold("_churn_prob"), "Predicted_CLTV": F.col("_cltv")}) \
            .drop("_churn_prob", "_cltv")


def simulate(base: DataFrame, levers: Levers, scorer: Scorer, id_col: str = "Customer_ID") -> DataFrame:
    """The simulated table with ``Simulated_Churn``,
    ``Simulated_CLTV`` and the baseline columns.  All levers at 0 return the
    baseline itself (simulated = predicted)."""
    if levers.is_baseline():
        return base.withColumns({"Simulated_Churn": F.col("Predicted_Churn").cast("double"),
                                 "Simulated_CLTV": F.col("Predicted_CLTV").cast("double"),
                                 "Baseline_Churn": F.col("Predicted_Churn"),
                                 "Baseline_CLTV": F.col("Predicted_CLTV")})
    changed = apply_levers(base, levers, id_col)
    s = scorer(changed)
    return (s.withColumns({"Simulated_Churn": threshold("_churn_prob"), "Simulated_CLTV": F.col("_cltv"),
                           "Baseline_Churn": F.col("Predicted_Churn"), "Baseline_CLTV": F.col("Predicted_CLTV")})
            .drop("_churn_prob", "_cltv"))


def whatif_kpis(sim: DataFrame) -> DataFrame:
    """One row of before/after figures."""
    bc, bv = F.col("Baseline_Churn").cast("double"), F.col("Baseline_CLTV").cast("double")
    sc, sv = F.col("Simulated_Churn"), F.col("Simulated_CLTV")
    k = sim.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(bv).alias("base_cltv_mean"), (F.avg(bc) * 100).alias("base_churn_pct"),
        F.sum(bv).alias("base_revenue"), F.sum(bc).cast("long").alias("base_churn_count"),
        F.avg(sv).alias("sim_cltv_mean"), (F.avg(sc) * 100).alias("sim_churn_pct"),
        F.sum(sv).alias("sim_revenue"), F.sum(sc).cast("long").alias("sim_churn_count"),
        (F.avg((sv > bv).cast("double")) * 100).alias("improved_pct"),
        F.count_if(sv > bv).alias("improved_count"), F.count_if(sv < bv).alias("worsened_count"))
    return k.withColumns({
        "avg_cltv_change": F.col("sim_cltv_mean") - F.col("base_cltv_mean"),
        "revenue_diff": F.col("sim_revenue") - F.col("base_revenue"),
        "churn_diff": F.col("sim_churn_count") - F.col("base_churn_count"),
        # card deltas in percent of the baseline (0 when the base is 0)
        "cltv_change_pct": pct_change("sim_cltv_mean", "base_cltv_mean"),
        "revenue_change_pct": pct_change("sim_revenue", "base_revenue"),
    })


def whatif_findings(kpis: DataFrame, levers: Levers, base: DataFrame | None = None) -> DataFrame:
    """One row ``(ord, severity, code, figure)`` per finding that fires.
    ``figure`` is the number the finding quotes (a count, amount or %)."""
    if levers.is_baseline():
        return kpis.select(F.lit(1).alias("ord"), F.lit("neutral").alias("severity"),
                           F.lit("BASELINE").alias("code"), F.lit(None).cast("double").alias("figure"))
    cd, rd = F.col("churn_diff"), F.col("revenue_diff")
    acd = F.col("avg_cltv_change")
    converted = F.lit(0.0)
    if levers.subscription > 0 and base is not None:
        single = base.agg(F.count_if(is_text_one("Total_Subscriptions"))).scalar()
        converted = F.least(F.floor(single * F.lit(levers.subscription / 100)), single).cast("double")
    c, s, p, u = levers.cashback, levers.support, levers.price, levers.subscription
    rows = [
        (1, F.when(cd < 0, "positive").when(cd > 0, "negative").otherwise("neutral"),
         F.when(cd < 0, "CHURN_DOWN").when(cd > 0, "CHURN_UP").otherwise("CHURN_SAME"), F.lit(True), cd.cast("double")),
        (2, F.when(rd > 0, "positive").when(rd < 0, "negative").otherwise("neutral"),
         F.when(rd > 0, "REVENUE_UP").when(rd < 0, "REVENUE_DOWN").otherwise("REVENUE_SAME"), F.lit(True),
         F.when(F.col("base_revenue") != 0, rd / F.col("base_revenue") * 100).otherwise(F.lit(0.0))),
        (3, F.when(acd > 0, "positive").otherwise("negative"), F.lit("AVG_CLTV"), F.abs(acd) > 0.01, acd),
        (4, F.lit("note"), F.lit("CASHBACK_UP"), F.lit(c > 0) & (cd < 0), F.lit(float(c))),
        (4, F.lit("note"), F.lit("CASHBACK_CUT"), F.lit(c < 0), F.lit(float(abs(c)))),
        (5, F.lit("note"), F.lit("SUPPORT"), F.lit(s > 0) & (cd <= 0), F.lit(float(s))),
        (6, F.lit("note"), F.lit("SUBSCRIPTION"), F.lit(u > 0) & (converted > 0), converted),
        (7, F.lit("note"), F.lit("MARKETING_UP"), F.lit(p > 0) & (rd > 0), F.lit(float(p))),
        (7, F.lit("note"), F.lit("MARKETING_CUT"), F.lit(p < 0), F.lit(float(abs(p)))),
        (8, F.lit("positive"), F.lit("OVERALL_GOOD"), (rd > 0) & (cd <= 0), rd),
        (8, F.lit("negative"), F.lit("OVERALL_BAD"), (rd < 0) & (cd > 0), rd),
        (8, F.lit("mixed"), F.lit("OVERALL_MIXED_REVENUE_UP"), (rd > 0) & (cd > 0), rd),
        (8, F.lit("mixed"), F.lit("OVERALL_MIXED_REVENUE_DOWN"), (rd < 0) & (cd < 0), rd),
    ]
    structs = [F.struct(F.lit(o).alias("ord"), sev.alias("severity"), code.alias("code"),
                        fires.alias("fires"), fig.cast("double").alias("figure"))
               for o, sev, code, fires, fig in rows]
    return (kpis.select(F.explode(F.array(*structs)).alias("f")).select("f.*")
            .where(F.col("fires")).drop("fires"))


# The lever table of the export (action, primary feature,
# correlated features).
LEVER_TABLE = [
    ("Increase Cashback Opportunities", "cashback", "Average_Cash_Back",
     "Satisfaction_Score, Loyalty_Engagement_Score, Days_Since_Last_Order"),
    ("More Marketing & Customer Incentives", "price", "Total_Amount_Spent",
     "Days_Since_Last_Order, Order_Amount_Hike_From_Last_Year, Satisfaction_Score, Loyalty_Engagement_Score"),
    ("Boost Customer Support Quality", "support", "Complain_Count_In_Last_Month",
     "Satisfaction_Score, Loyalty_Engagement_Score, Days_Since_Last_Order"),
    ("Subscription Push", "subscription", "Total_Subscriptions",
     "Loyalty_Engagement_Score, Satisfaction_Score"),
]


def lever_table(spark, levers: Levers) -> DataFrame:
    """The four actions with their slider values (four literal rows)."""
    rows = [(a, float(getattr(levers, k)), p, c) for a, k, p, c in LEVER_TABLE]
    return spark.createDataFrame(rows, "Action string, Slider_Value double, Primary_Feature string, "
                                       "Correlated_Features string")
