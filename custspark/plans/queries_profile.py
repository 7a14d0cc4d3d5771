"""Registered queries: profiles and grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, sketches
from ..session import cut_lineage, scratch_path
from ..sources import adapters
from . import customer360 as c360
from .catalog import query, round_doubles


def rsql(body: str, cols: list[str], places: int = 6) -> str:
    """SQL twin of :func:`round_doubles`: round listed double columns."""
    rep = ", ".join(f"round({c}, {places}) as {c}" for c in cols)
    return f"select * replace ({rep}) from ({body})"


GREEN_SCORES = ["Cultural_Eco_Alignment", "Emotional_Guilt_Score", "Emotional_Pride_Score",
                "Social_Influence_Score", "Green_Knowledge_Level", "Time_Spent_on_Green_Products",
                "Clicks_on_Green_Products", "Previous_Green_Purchases"]


@query("groups_with_many_values", sql="""
select Customer_ID, count(distinct Customer_Age) as n_values from a_purchases
group by 1 having count(distinct Customer_Age) >= 2""")
def groups_with_many_values(t):
    """A2: customers recorded with more than one age."""
    return profile.groups_with_many_values(adapters.purchases(t), "Customer_ID", "Customer_Age")


@query("value_counts_top", sql="""
select Product_ID, count(*) as count from a_order_products group by 1
order by count desc, Product_ID limit 20""")
def value_counts_top(t):
    """A4: the 20 most ordered products."""
    return profile.value_counts(adapters.order_items(t), "Product_ID", top=20)


@query("value_share", sql="""
select Preferred_Login_Device, count(*) as count,
  round_even(count(*) * 100.0 / (select count(*) from a_churn_clean), 2) as share_pct
from a_churn_clean group by 1""")
def value_share(t):
    """A5: share of each login device in percent."""
    return profile.value_share(c360.clean_churn(adapters.churn(t)), "Preferred_Login_Device")


@query("orders_histogram", sql="""
select n, count(*) as groups from (select Customer_ID, count(*) as n from a_orders group by 1) group by 1""")
def orders_histogram(t):
    """How many customers placed n orders."""
    return profile.count_of_counts(adapters.orders(t), "Customer_ID")


@query("rate_by_category", sql=rsql("""
select Preferred_Login_Device, avg(Churn) as rate, count(*) as rows from a_churn_clean group by 1""", ["rate"]))
def rate_by_category(t):
    """Churn rate per login device."""
    df = profile.rate_by_category(c360.clean_churn(adapters.churn(t)), "Preferred_Login_Device", "Churn")
    return round_doubles(df, 6)


@query("reorders_by_department", sql="""
select d.Department_Name, cast(sum(op.Was_Product_Reordered) as bigint) as total
from a_order_products op join a_products p on op.Product_ID = p.Product_ID
join a_departments d on p.Department_ID = d.Department_ID
group by 1 order by total desc, d.Department_Name limit 10""")
def reorders_by_department(t):
    """The ten departments with the most re-ordered lines."""
    return profile.top_sums(adapters.brand_purchases(t), "Department_Name", "reorders", 10)


@query("means_by_class", sql=rsql("""
select feature, avg(case when Green_Purchase_Made = 0 then v end) as class_0,
  avg(case when Green_Purchase_Made = 1 then v end) as class_1
from (unpivot a_green on {cols} into name feature value v) group by feature
""".replace("{cols}", ", ".join(f"cast({c} as double) as {c}" for c in GREEN_SCORES)), ["class_0", "class_1"]))
def means_by_class(t):
    """Mean attitude scores of buyers and non-buyers, features as rows."""
    return round_doubles(profile.means_by_class(adapters.green(t), "Green_Purchase_Made",
                                                GREEN_SCORES, [0, 1]), 6)


@query("entity_counts", sql="""
select count(distinct o.Order_ID) as n_Order_ID, count(distinct o.Customer_ID) as n_Customer_ID,
  count(distinct op.Product_ID) as n_Product_ID, count(distinct p.Department_ID) as n_Department_ID
from a_orders o join a_order_products op on o.Order_ID = op.Order_ID
join a_products p on op.Product_ID = p.Product_ID""")
def entity_counts(t):
    """Distinct orders, customers, products, departments in the order lines."""
    lines = (adapters.orders(t).join(adapters.order_items(t), "Order_ID")
             .join(adapters.products(t), "Product_ID"))
    return profile.entity_counts(lines, ["Order_ID", "Customer_ID", "Product_ID", "Department_ID"])


@query("entity_sketches", sql=" union all ".join(
    f"select '{c}' as subset, count(*) as \"rows\", true as within_bound from a_orders o join a_order_products op on o.Order_ID = op.Order_ID"
    for c in ("Order_ID", "Customer_ID", "Product_ID", "Customer_ID+Product_ID")))
def entity_sketches(t):
    """Distinct counts from sketches kept by month of the order and merged, held against the exact counts."""
    lines = cut_lineage(t.orders.select(F.col("o_orderkey").alias("Order_ID"), F.col("o_custkey").alias("Customer_ID"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
                        .join(adapters.order_items(t), "Order_ID"))
    sets = [["Order_ID"], ["Customer_ID"], ["Product_ID"], ["Customer_ID", "Product_ID"]]
    path = scratch_path(t.spark, "sketches")
    sketches.keep(sketches.column_sketches(lines, sets, ["month"]), path, "month")
    counts = sketches.merged_counts(sketches.kept(t.spark, path))
    exact = lines.agg(*[F.count_distinct(*s).alias("+".join(s)) for s in sets])
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit("+".join(s)).alias("subset"), F.col("`" + "+".join(s) + "`").alias("exact")) for s in sets])).alias("e")).select("e.*")
    within = F.abs(F.col("distinct_values") - F.col("exact")) <= F.lit(sketches.error_bound()) * F.col("exact")
    return counts.join(exact, "subset").select("subset", "rows", within.alias("within_bound"))


@query("duplicate_pairs", sql="""
select 'all_columns' as subset, count(*) - (select count(*) from (select distinct * from a_order_products)) as duplicates from a_order_products
union all select 'Order_ID', count(*) - count(distinct Order_ID) from a_order_products
union all select 'Order_ID+Product_ID', count(*) - (select count(*) from (select distinct Order_ID, Product_ID from a_order_products)) from a_order_products""")
def duplicate_pairs(t):
    """Duplicate whole rows, order ids and (order, product) pairs."""
    return profile.duplicate_counts(adapters.order_products(t), [["Order_ID"], ["Order_ID", "Product_ID"]])


_CHURN_COLS = ["Customer_ID", "Preferred_Login_Device", "City_Tier", "Preferred_Payment_Mode",
               "Hours_Spend_On_Website", "Total_Devices_Registered", "Satisfaction_Score",
               "Marital_Status", "Complain_Count_In_Last_Month", "Order_Amount_Hike_From_Last_Year",
               "Discount_Coupon_Used_Count", "Days_Since_Last_Order", "Average_Cash_Back", "Churn"]


@query("missing_report", sql=" union all ".join(
    f"select '{c}' as column, count(*) filter (where {c} is null) as missing, "
    f"round_even(count(*) filter (where {c} is null) * 100.0 / count(*), 2) as missing_pct from a_churn"
    for c in _CHURN_COLS))
def missing_report(t):
    """Missing values per column of the raw churn source."""
    return profile.missing_report(adapters.churn(t))


@query("null_count_distribution", sql="""
select {n} as nulls_in_row, count(*) as rows from a_churn group by 1""".replace(
    "{n}", " + ".join(f"(case when {c} is null then 1 else 0 end)" for c in _CHURN_COLS)))
def null_count_distribution(t):
    """Rows by number of missing cells."""
    return profile.null_count_distribution(adapters.churn(t))


_CHURN_TEXT = ["Preferred_Login_Device", "Preferred_Payment_Mode", "Hours_Spend_On_Website", "Marital_Status"]


@query("cardinality", sql=" union all ".join(
    f"select '{c}' as column, count(distinct {c}) as distinct_values from a_churn" for c in _CHURN_TEXT))
def cardinality(t):
    """Distinct values of every text column of the raw churn source."""
    return profile.cardinality(adapters.churn(t))


_GREEN_NUM = ["Cultural_Eco_Alignment", "Time_Spent_on_Green_Products", "Clicks_on_Green_Products",
              "Green_Consumption_Score"]


@query("numeric_profile", sql=rsql(" union all ".join(
    f"select '{c}' as column, count({c}) as count, avg({c}) as mean, stddev_samp({c}) as std, "
    f"cast(min({c}) as double) as min, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as median, "
    f"quantile_cont({c}, 0.75) as q75, cast(max({c}) as double) as max from a_green" for c in _GREEN_NUM),
    ["mean", "std", "q25", "median", "q75"]))
def numeric_profile(t):
    """describe() of green attitude columns with exact quartiles."""
    return round_doubles(profile.numeric_profile(adapters.green(t), _GREEN_NUM), 6)


_SKEW_COLS = ["Total_Amount_Spent", "Days_Since_Last_Order", "Total_Orders_This_Month"]


@query("skew_profile", sql=rsql(" union all ".join(
    f"select '{c}' as column, avg({c}) as mean, cast(median({c}) as double) as median, skewness({c}) as skew "
    f"from a_customer360" for c in _SKEW_COLS), ["mean", "median", "skew"]))
def skew_profile(t):
    """Mean, median and bias-corrected skew of spend, recency, orders."""
    return round_doubles(profile.skew_profile(c360.customer_360_materialized(t), _SKEW_COLS), 6)


_CORR_COLS = ["Cultural_Eco_Alignment", "Emotional_Guilt_Score", "Time_Spent_on_Green_Products",
              "Clicks_on_Green_Products", "Green_Consumption_Score"]


@query("correlation_long", sql=rsql(" union all ".join(
    f"select '{a}' as a, '{b}' as b, corr(cast({a} as double), cast({b} as double)) as corr from a_green"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]), ["corr"]))
def correlation_long(t):
    """Pairwise-complete correlations of green columns, long form."""
    return round_doubles(profile.correlation_long(adapters.green(t), _CORR_COLS), 6)


_BINS_SQL = """
with m as (select cast(min({c}) as double) lo, cast(max({c}) as double) hi from {t}),
b as (select case when (m.hi - m.lo) / 10.0 = 0 then 1 else
        least(10, {expr}) end as bin, m.lo, (m.hi - m.lo) / 10.0 as w
      from {t}, m where {c} is not null)
select cast(g.bin as int) as bin, (select count(*) from b where b.bin = g.bin) as count,
  m.lo + (g.bin - 1) * ((m.hi - m.lo) / 10.0) as lower, m.lo + g.bin * ((m.hi - m.lo) / 10.0) as upper
from range(1, 11) g(bin), m where m.lo is not null"""


@query("equal_width_bins", sql=rsql(_BINS_SQL.format(
    c="Customer_Live_Time_Value", t="a_cltv",
    expr="greatest(1, ceil((cast(Customer_Live_Time_Value as double) - m.lo) / ((m.hi - m.lo) / 10.0)))"),
    ["lower", "upper"]))
def equal_width_bins(t):
    """Ten right-closed equal-width bins of lifetime value (pd.cut form)."""
    return round_doubles(profile.equal_width_bins(adapters.cltv(t), "Customer_Live_Time_Value", 10), 6)


@query("histogram_bins", sql=rsql(_BINS_SQL.format(
    c="Loyalty_Engagement_Score", t="a_cltv",
    expr="floor((cast(Loyalty_Engagement_Score as double) - m.lo) / ((m.hi - m.lo) / 10.0)) + 1"),
    ["lower", "upper"]))
def histogram_bins(t):
    """Ten left-closed bins of loyalty score, maximum in the last (numpy form)."""
    return round_doubles(profile.equal_width_bins(adapters.cltv(t), "Loyalty_Engagement_Score", 10,
                                                  right_closed=False), 6)


@query("cond_counts", sql="""
select count(*) as total, count(*) filter (where event_type = 'purchase') as purchases,
  count(*) filter (where event_type = 'signup') as signups, count(*) filter (where event_type = 'error') as errors,
  count(*) filter (where event_type = 'purchase' and value > 100) as large_purchases from events""")
def cond_counts(t):
    """Conditional counts over the event stream in one pass."""
    e = F.col("event_type")
    return profile.conditional_counts(t.events, {
        "purchases": e == "purchase", "signups": e == "signup", "errors": e == "error",
        "large_purchases": (e == "purchase") & (F.col("value") > 100)})


@query("predicate_share", sql=rsql("""
select avg(case when Complain_Count_In_Last_Month = 0 then 1 else 0 end) * 100.0 as share_pct
from a_churn_clean""", ["share_pct"]))
def predicate_share(t):
    """Percent of customers without a complaint."""
    df = c360.clean_churn(adapters.churn(t))
    return round_doubles(profile.predicate_share(df, F.col("Complain_Count_In_Last_Month") == 0), 6)


_IQR_COLS = ["Total_Amount_Spent", "Days_Since_Last_Order", "Average_Cash_Back", "Total_Returns",
             "Loyalty_Engagement_Score", "Customer_Live_Time_Value", "Total_Orders_This_Month"]


@query("iqr_outliers", sql="select * from (" + " union all ".join(
    f"select '{c}' as column, count(*) filter (where {c} < q[1] - 1.5 * (q[2] - q[1]) or {c} > q[2] + 1.5 * (q[2] - q[1])) as outliers "
    f"from a_customer360, (select quantile_cont(cast({c} as double), [0.25, 0.75]) as q from a_customer360)"
    for c in _IQR_COLS) + ") where outliers > 0")
def iqr_outliers(t):
    """Outliers beyond 1.5 IQR per numeric column of the customer table."""
    return profile.iqr_outliers(c360.customer_360_materialized(t), _IQR_COLS)


@query("class_ratio", sql=rsql("""
select count(*) filter (where Churn = 1) as positives, count(*) filter (where Churn <> 1) as negatives,
  sqrt(count(*) filter (where Churn <> 1) / count(*) filter (where Churn = 1)) as ratio from a_churn_clean""",
    ["ratio"]))
def class_ratio(t):
    """Class weight sqrt(negatives / positives) for churn."""
    return round_doubles(profile.class_ratio(c360.clean_churn(adapters.churn(t)), "Churn"), 6)


@query("suffix_counts", sql="""
select suffix, count(*) as count from (select nullif(regexp_extract(Hours_Spend_On_Website, '([A-Za-z]+)$', 1), '') as suffix
from a_churn) where suffix is not null group by 1""")
def suffix_counts(t):
    """Trailing unit letters of the hours column."""
    return profile.suffix_counts(adapters.churn(t), "Hours_Spend_On_Website")


@query("contingency", sql="""
select Marital_Status, count(*) filter (where Churn = 0) as Churn_0, count(*) filter (where Churn = 1) as Churn_1
from a_churn_clean group by 1""")
def contingency(t):
    """Crosstab of marital status and churn."""
    return profile.contingency(c360.clean_churn(adapters.churn(t)), "Marital_Status", "Churn", [0, 1])


_CHI_SQL = """
with cells as (select {a} as a, {b} as b, count(*) as o from a_churn_clean where {a} is not null and {b} is not null group by 1, 2),
ra as (select a, sum(o) as ra from cells group by 1), cb as (select b, sum(o) as cb from cells group by 1),
tot as (select sum(o) as t from cells),
dims as (select (count(distinct a) - 1) * (count(distinct b) - 1) as dof from cells),
full_grid as (select ra.a, cb.b, ra.ra, cb.cb, coalesce(cells.o, 0) as o from ra cross join cb
              left join cells on cells.a = ra.a and cells.b = cb.b)
select round(sum(pow(case when dims.dof = 1 then greatest(abs(o - ra * cb / tot.t) - 0.5, 0)
                     else abs(o - ra * cb / tot.t) end, 2) / (ra * cb / tot.t)), 6) as statistic,
  cast(any_value(dims.dof) as bigint) as dof
from full_grid, tot, dims"""


@query("chi_square_stat", sql=_CHI_SQL.format(a="Marital_Status", b="Churn"))
def chi_square_stat(t):
    """Chi-square statistic and dof, marital status vs churn."""
    df = profile.chi_square(c360.clean_churn(adapters.churn(t)), "Marital_Status", "Churn", with_p=False)
    return round_doubles(df, 6)


@query("chi_square_yates", sql=_CHI_SQL.format(a="Complain_Count_In_Last_Month", b="Churn"))
def chi_square_yates(t):
    """2x2 table (complaint vs churn) with Yates' correction."""
    df = profile.chi_square(c360.clean_churn(adapters.churn(t)), "Complain_Count_In_Last_Month", "Churn",
                            with_p=False)
    return round_doubles(df, 6)


@query("chi_square_test")
def chi_square_test(t):
    """M12 with p-value (upper chi-square tail of the statistic)."""
    return profile.chi_square(c360.clean_churn(adapters.churn(t)), "Marital_Status", "Churn")
