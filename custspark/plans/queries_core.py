"""Registered queries: customer table, cleaning, joins, windows, set ops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..operators import clean, joins, ranking, sampling, setops
from ..sources import adapters
from . import customer360 as c360
from .catalog import query

# --- customer table ----------------------------------------------------------


@query("customer_360", sql="""
select * from a_customer360""")
def customer_360(t):
    """Flagship: one row per customer from five sources."""
    return c360.customer_360(t)


@query("customer_360_from_sources", sql="select * from a_customer360")
def customer_360_from_sources(t):
    """The same table from separately delivered sources
    (cleaned churn and value tables, transactions, orders, order lines,
    products, departments) joined on the customer key."""
    return c360.merge_sources(c360.clean_churn(adapters.churn(t)), c360.clean_cltv(adapters.cltv(t)),
                              adapters.purchases(t), adapters.orders(t), adapters.order_items(t),
                              adapters.products(t), adapters.departments(t))


@query("customer_rollup", sql="""
select * from a_purchase_agg""")
def customer_rollup(t):
    """A1: modal age, total spend and returns per customer."""
    return c360.purchase_rollup(adapters.purchases(t))


@query("preferred_department", sql="select * from a_pref_dept")
def preferred_department(t):
    """Most frequent department per customer, ties to the lowest id."""
    return c360.preferred_department(adapters.orders(t), adapters.order_items(t),
                                     adapters.products(t), adapters.departments(t))


@query("churn_cleaned", sql="select * from a_churn_clean")
def churn_cleaned(t):
    """Cleaned churn source."""
    return c360.clean_churn(adapters.churn(t))


@query("engineered_features", sql="""
select Customer_ID, Total_Orders_This_Month * Total_Amount_Spent / 1000.0 as Purchase_Intensity,
  Days_Since_Last_Order as Recency,
  Total_Amount_Spent / (Total_Orders_This_Month + 1.0) as Avg_Spend_Per_Order
from a_customer360""")
def engineered_features(t):
    """Purchase intensity, recency, average spend per order."""
    df = c360.segmentation_features(c360.customer_360(t))
    return df.select("Customer_ID", "Purchase_Intensity", "Recency", "Avg_Spend_Per_Order")


# --- cleaning ----------------------------------------------------------------


@query("drop_rename_select", sql="""
select Customer_ID, Preferred_Login_Device as Login_Device, Preferred_Payment_Mode, Marital_Status,
  Satisfaction_Score, Average_Cash_Back, Churn from a_churn""")
def drop_rename_select(t):
    """Drop columns, rename, target last."""
    df = clean.drop_columns(adapters.churn(t), ["City_Tier", "Hours_Spend_On_Website", "Total_Devices_Registered",
                                                "Complain_Count_In_Last_Month", "Order_Amount_Hike_From_Last_Year",
                                                "Discount_Coupon_Used_Count", "Days_Since_Last_Order", "Not_There"])
    df = clean.rename_columns(df, {"Preferred_Login_Device": "Login_Device"})
    return clean.target_last(df, "Churn")


@query("dropna_any", sql="select * from a_churn where Hours_Spend_On_Website is not null and Order_Amount_Hike_From_Last_Year is not null")
def dropna_any(t):
    """Rows without any gap."""
    return clean.drop_nulls(adapters.churn(t))


@query("null_budget_filter", sql="""
select * from a_churn where (case when Hours_Spend_On_Website is null then 1 else 0 end
  + case when Order_Amount_Hike_From_Last_Year is null then 1 else 0 end) < 2""")
def null_budget_filter(t):
    """P5: rows with fewer than two gaps (before any fill)."""
    return clean.keep_rows_with_few_nulls(adapters.churn(t), 2)


@query("category_merge", sql="""
select case when Preferred_Login_Device = 'Phone' then 'Mobile Phone' else Preferred_Login_Device end as Preferred_Login_Device,
  count(*) as count from a_churn group by 1""")
def category_merge(t):
    """Device spellings merged, counted."""
    df = clean.merge_categories(adapters.churn(t), "Preferred_Login_Device", {"Phone": "Mobile Phone"})
    return df.groupBy("Preferred_Login_Device").agg(F.count(F.lit(1)).alias("count"))


@query("numeric_coerce", sql="""
select Customer_ID, try_cast(nullif(regexp_replace(Hours_Spend_On_Website, '[^0-9.]', '', 'g'), '') as double) as Hours_Spend_On_Website
from a_churn""")
def numeric_coerce(t):
    """P7: '3h' -> 3.0, gaps stay NULL."""
    df = clean.coerce_numeric(adapters.churn(t), ["Hours_Spend_On_Website"])
    return df.select("Customer_ID", "Hours_Spend_On_Website")


@query("median_fill", sql="""
select Customer_ID, cast(trunc(coalesce(Order_Amount_Hike_From_Last_Year,
  (select median(Order_Amount_Hike_From_Last_Year) from a_churn))) as bigint) as Order_Amount_Hike_From_Last_Year
from a_churn""")
def median_fill(t):
    """Interpolated median fill, truncated to whole numbers."""
    df = clean.coerce_numeric(adapters.churn(t), ["Order_Amount_Hike_From_Last_Year"])
    df = clean.truncate_to_long(clean.fill_median(df, ["Order_Amount_Hike_From_Last_Year"]),
                                ["Order_Amount_Hike_From_Last_Year"])
    return df.select("Customer_ID", "Order_Amount_Hike_From_Last_Year")


@query("mode_fill", sql="""
select 'Hours_Spend_On_Website' as column, 'mode' as method,
  (select Hours_Spend_On_Website from a_churn where Hours_Spend_On_Website is not null
   group by 1 order by count(*) desc, 1 limit 1) as value
union all
select 'Order_Amount_Hike_From_Last_Year', 'median',
  cast((select median(Order_Amount_Hike_From_Last_Year) from a_churn) as double)::varchar""")
def mode_fill(t):
    """P10: automatic fill plan: median for numbers, mode for the rest."""
    _, actions = clean.auto_fill(adapters.churn(t))
    return actions


@query("dedupe_counts", sql="""
select count(*) as rows_before, (select count(*) from (select distinct Order_ID, Product_ID from a_order_products)) as rows_after,
  count(*) - (select count(*) from (select distinct Order_ID, Product_ID from a_order_products)) as removed
from a_order_products""")
def dedupe_counts(t):
    """Duplicate (order, product) lines removed and counted."""
    _, report = clean.dedupe_with_counts(adapters.order_items(t))
    return report


@query("round_half_even", sql="""
select Customer_ID, cast(round_even(Time_Spent_on_Green_Products, 0) as double) as Time_Rounded,
  round_even(Green_Consumption_Score * 10, 0) as Score_Tenths from a_green""")
def round_half_even(t):
    """Numpy-style half-to-even rounding."""
    g = adapters.green(t)
    return g.select("Customer_ID", fx.round_half_even("Time_Spent_on_Green_Products").alias("Time_Rounded"),
                    fx.round_half_even(F.col("Green_Consumption_Score") * 10).alias("Score_Tenths"))


@query("zero_pad_id", sql="""
select Customer_ID, lpad(cast(Customer_ID as varchar), cast(greatest(4, length(cast(Customer_ID as varchar))) as int), '0') as Customer_Code
from a_churn""")
def zero_pad_id(t):
    """Zero-padded id text that never truncates."""
    return adapters.churn(t).select("Customer_ID", fx.zero_pad("Customer_ID", 4).alias("Customer_Code"))


@query("income_letters", sql="select Customer_ID, replace(Customer_Income, 'L', 'K') as Customer_Income from a_cltv")
def income_letters(t):
    """Lakh bands written with K."""
    return adapters.cltv(t).select("Customer_ID", fx.replace_letter("Customer_Income", "L", "K").alias("Customer_Income"))


_AUDIT_TEXT = ["user_email", "role", "organization_id", "action_type", "page_name", "file_name", "details"]


def _format_sql(c: str) -> str:
    if "email" in c:
        bad = f"count(*) filter (where {c} is null or not regexp_matches({c}, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$'))"
        return (f"select '{c}' as column, 'email_pattern' as \"check\", {bad} as bad_rows, "
                f"case when {bad} = 0 then 'ok' else 'invalid' end as status from a_audit")
    bad = f"count(*) filter (where {c} is not null and try_cast({c} as double) is null)"
    return (f"select '{c}' as column, 'numeric_as_text' as \"check\", {bad} as bad_rows, "
            f"case when {bad} = 0 and count({c}) > 0 then 'stored_as_text' else 'ok' end as status from a_audit")


@query("format_audit", sql=" union all ".join(_format_sql(c) for c in _AUDIT_TEXT))
def format_audit(t):
    """Format checks of the text columns of the audit log."""
    return clean.format_audit(adapters.audit_logs(t))


@query("whole_float_columns", sql="""
select Customer_ID, cast(Time_Spent_on_Green_Products as double) as Time_Spent_on_Green_Products,
  cast(Green_Consumption_Score * 100 as bigint) as Score_Pct from a_green""")
def whole_float_columns(t):
    """P20: double columns holding only whole numbers become longs."""
    g = adapters.green(t).select("Customer_ID", "Time_Spent_on_Green_Products",
                                 F.round(F.col("Green_Consumption_Score") * 100, 6).alias("Score_Pct"))
    return clean.whole_float_to_long(g)


# --- joins -------------------------------------------------------------------


@query("inner_join_row_loss", sql="""
select (select count(*) from a_churn_clean) as rows_before,
  (select count(*) from a_churn_clean c where not exists (select 1 from a_purchase_agg p where p.Customer_ID = c.Customer_ID)) as rows_dropped""")
def inner_join_row_loss(t):
    """Churn joined to purchase roll-up and the rows lost."""
    _, report = joins.inner_join_with_loss(c360.clean_churn(adapters.churn(t)),
                                           c360.purchase_rollup(adapters.purchases(t)), "Customer_ID")
    return report


@query("order_product_department", sql="""
select o.Order_ID, o.Customer_ID, op.Product_ID, p.Department_ID, d.Department_Name
from a_orders o join a_order_products op on o.Order_ID = op.Order_ID
join a_products p on op.Product_ID = p.Product_ID join a_departments d on p.Department_ID = d.Department_ID""")
def order_product_department(t):
    """Order -> product -> department chain."""
    return (adapters.orders(t).join(adapters.order_items(t), "Order_ID")
            .join(adapters.products(t).select("Product_ID", "Department_ID"), "Product_ID")
            .join(joins.broadcast_bounded(adapters.departments(t), 10000), "Department_ID")
            .select("Order_ID", "Customer_ID", "Product_ID", "Department_ID", "Department_Name"))


@query("left_lookup", sql="""
select op.Order_ID, op.Product_ID, p.Product_Name from a_order_products op left join a_products p on op.Product_ID = p.Product_ID""")
def left_lookup(t):
    """Product names looked up for every order line."""
    return (adapters.order_items(t)
            .join(adapters.products(t).select("Product_ID", "Product_Name"), "Product_ID", "left"))


@query("department_name_lookup", sql="""
select c.Customer_ID, d.Department_Name as Preferred_Name from a_pref_dept c
left join a_departments d on c.Preferred_Order_Category = d.Department_ID""")
def department_name_lookup(t):
    """Left join on differently named keys."""
    pref = c360.preferred_department(adapters.orders(t), adapters.order_items(t), adapters.products(t),
                                     adapters.departments(t))
    d = adapters.departments(t)
    return (pref.join(d, pref["Preferred_Order_Category"] == d["Department_ID"], "left")
            .select(pref["Customer_ID"], d["Department_Name"].alias("Preferred_Name")))


@query("semi_join_orders", sql="""
select * from a_orders o where exists (select 1 from a_order_products op where op.Order_ID = o.Order_ID)""")
def semi_join_orders(t):
    """Orders that have at least one line."""
    return joins.semi_join(adapters.orders(t), adapters.order_items(t), "Order_ID")


@query("orders_without_lines", sql="""
select (select count(distinct Order_ID) from a_orders o where not exists (select 1 from a_order_products op where op.Order_ID = o.Order_ID)) as orders_without_lines,
  (select count(distinct Product_ID) from a_products p where not exists (select 1 from a_order_products op where op.Product_ID = p.Product_ID)) as products_never_ordered""")
def orders_without_lines(t):
    """Orders with no line, products never ordered."""
    op = adapters.order_items(t)
    a = joins.anti_join(adapters.orders(t), op, "Order_ID").agg(F.countDistinct("Order_ID").alias("orders_without_lines"))
    b = joins.anti_join(adapters.products(t), op, "Product_ID").agg(F.countDistinct("Product_ID"))
    return a.withColumn("products_never_ordered", b.scalar())


@query("dense_ids", sql="""
select Customer_ID, row_number() over (order by Customer_ID) as new_id from (select distinct Customer_ID from a_purchases)""")
def dense_ids(t):
    """Customers renumbered 1..n in id order, without a one-task sort."""
    return ranking.dense_ids(adapters.purchases(t), "Customer_ID")


@query("id_map", sql="""
select o.Order_ID, m.new_id as Customer_ID from a_orders o join
  (select Customer_ID, row_number() over (order by Customer_ID) as new_id from (select distinct Customer_ID from a_orders)) m
  on o.Customer_ID = m.Customer_ID""")
def id_map(t):
    """Order customer ids mapped to dense ids by a join."""
    o = adapters.orders(t)
    return joins.map_ids(o, ranking.dense_ids(o, "Customer_ID"), "Customer_ID", "new_id", require_complete=True)


@query("sequential_ids", sql="""
select Customer_ID, row_number() over (order by md5(cast(Customer_ID as varchar)), Customer_ID) as seq_id from a_cltv""")
def sequential_ids(t):
    """1..n in a stated (hash) order."""
    c = adapters.cltv(t).select("Customer_ID")
    return ranking.sequential_ids(c, [sampling.hash_order("Customer_ID"), F.col("Customer_ID")])


# --- selections ----------------------------------------------------------------


@query("first_n_customers", sql="""
select * from a_purchases where Customer_ID in (select distinct Customer_ID from a_purchases order by 1 limit 500)""")
def first_n_customers(t):
    """Transactions of the first 500 customer ids."""
    return sampling.first_n_ids(adapters.purchases(t), "Customer_ID", 500)


@query("majority_downsample", sql="""
with c as (select * from a_churn_clean),
n as (select count(*) - 1200 as excess, count(*) filter (where Churn = 0) as n0 from c),
r as (select Customer_ID, row_number() over (order by md5(cast(Customer_ID as varchar)), Customer_ID) as rn from c where Churn = 0)
select c.Customer_ID, c.Churn from c where c.Customer_ID not in
  (select r.Customer_ID from r, n where n.excess > 0 and n.n0 >= n.excess and r.rn <= n.excess)""")
def majority_downsample(t):
    """Cap at 1,200 rows dropping non-churners only, in hash order."""
    df = c360.clean_churn(adapters.churn(t))
    return sampling.majority_downsample(df, "Customer_ID", "Churn", 1200).select("Customer_ID", "Churn")


@query("quota_sample", sql="""
with cnt as (select Customer_ID, count(*) as n from a_orders group by 1),
s as (select Customer_ID, case when n >= 3 then 3 else n end as stratum from cnt),
k as (select count(*) filter (where stratum = 1) n1, count(*) filter (where stratum = 2) n2,
             count(*) filter (where stratum = 3) n3 from s),
q as (select n1, n2, n3, 1500 - n3 as need, least(n1, 1) as q1, least(n2, 1500 - n3 - least(n1, 1)) as q2 from k),
qf as (select case when q2 < q1 then need - (q2 + least(n2 - q2, q1 - q2 + 100)) else q1 end as f1,
              case when q2 < q1 then q2 + least(n2 - q2, q1 - q2 + 100) else q2 end as f2 from q),
r as (select Customer_ID, stratum, row_number() over (partition by stratum order by md5(cast(Customer_ID as varchar)), Customer_ID) rn
      from s where stratum < 3)
select Customer_ID, stratum from s where stratum = 3
union all select r.Customer_ID, r.stratum from r, qf
 where (r.stratum = 1 and r.rn <= greatest(qf.f1, 0)) or (r.stratum = 2 and r.rn <= greatest(qf.f2, 0))""")
def quota_sample(t):
    """All customers with 3+ orders, then 2s and 1s by quota (total 1,500, at least 1 single)."""
    counts = adapters.orders(t).groupBy("Customer_ID").agg(F.count(F.lit(1)).alias("n"))
    return sampling.quota_sample(counts, "Customer_ID", "n", total=1500, min_single=1)


@query("stratified_split", sql="""
select Customer_ID, Churn, case when row_number() over (partition by Churn order by md5(cast(Customer_ID as varchar)), Customer_ID)
  <= floor(count(*) over (partition by Churn) * 0.2 + 0.5) then 'test' else 'train' end as split
from a_churn_clean""")
def stratified_split(t):
    """80/20 split with the churn share kept in both parts."""
    df = c360.clean_churn(adapters.churn(t)).select("Customer_ID", "Churn")
    return sampling.stratified_split(df, "Customer_ID", "Churn", 0.2)


@query("split_side_tables", sql="""
with s as (select Customer_ID, case when row_number() over (partition by Churn order by md5(cast(Customer_ID as varchar)), Customer_ID)
  <= floor(count(*) over (partition by Churn) * 0.2 + 0.5) then 'test' else 'train' end as split from a_churn_clean)
select o.* from a_orders o where o.Customer_ID in (select Customer_ID from s where split = 'train')""")
def split_side_tables(t):
    """Orders of the training customers."""
    split = sampling.stratified_split(c360.clean_churn(adapters.churn(t)).select("Customer_ID", "Churn"),
                                      "Customer_ID", "Churn", 0.2)
    return sampling.split_side_tables(split, adapters.orders(t), "Customer_ID", "train")


_SPLIT_SQL = """
with s as (select Customer_ID, case when row_number() over (partition by Churn order by md5(cast(Customer_ID as varchar)), Customer_ID)
  <= floor(count(*) over (partition by Churn) * 0.2 + 0.5) then 'test' else 'train' end as split from a_churn_clean)"""


def _split(t):
    return sampling.stratified_split(c360.clean_churn(adapters.churn(t)).select("Customer_ID", "Churn"), "Customer_ID", "Churn", 0.2)


@query("split_green_train", sql=_SPLIT_SQL + """
select g.Customer_ID, g.Referral_Source, g.Green_Consumption_Score, g.Green_Purchase_Made from a_green g
where g.Customer_ID in (select Customer_ID from s where split = 'train')""")
def split_green_train(t):
    """Green rows of the training customers."""
    return sampling.split_side_tables(_split(t), adapters.green(t), "Customer_ID", "train").select(
        "Customer_ID", "Referral_Source", "Green_Consumption_Score", "Green_Purchase_Made")


@query("split_test_baskets", sql=_SPLIT_SQL + """
select o.Customer_ID, op.Order_ID, op.Product_ID, op.Was_Product_Reordered, p.Department_ID, d.Department_Name
from a_order_products op join a_orders o on op.Order_ID = o.Order_ID
left join a_products p on op.Product_ID = p.Product_ID left join a_departments d on p.Department_ID = d.Department_ID
where o.Customer_ID in (select Customer_ID from s where split = 'test')""")
def split_test_baskets(t):
    """Order lines of the test customers with department and customer."""
    orders = sampling.split_side_tables(_split(t), adapters.orders(t), "Customer_ID", "test")
    lines = adapters.order_products(t).join(orders.select("Order_ID", "Customer_ID"), "Order_ID")
    return (lines.join(adapters.products(t).select("Product_ID", "Department_ID"), "Product_ID", "left")
            .join(adapters.departments(t), "Department_ID", "left")
            .select("Customer_ID", "Order_ID", "Product_ID", "Was_Product_Reordered", "Department_ID", "Department_Name"))


# --- set operations and sorting ----------------------------------------------------


@query("union_strata", sql="""
select Customer_ID, n from (select Customer_ID, count(*) n from a_orders group by 1) where n >= 12
union all select Customer_ID, n from (select Customer_ID, count(*) n from a_orders group by 1) where n = 2
union all select Customer_ID, n from (select Customer_ID, count(*) n from a_orders group by 1) where n = 1""")
def union_strata(t):
    """Union of customer strata with the same columns."""
    counts = adapters.orders(t).groupBy("Customer_ID").agg(F.count(F.lit(1)).alias("n"))
    return setops.union_all([counts.where("n >= 12"), counts.where("n = 2"), counts.where("n = 1")])


@query("union_missing_cols", sql="""
select Customer_ID, Churn, cast(null as varchar) as Membership_Type from a_churn
union all select Customer_ID, null, Membership_Type from a_cltv""")
def union_missing_cols(t):
    """Union by name where each side lacks a column."""
    return setops.union_missing([adapters.churn(t).select("Customer_ID", "Churn"),
                                 adapters.cltv(t).select("Customer_ID", "Membership_Type")])


@query("key_difference", sql="""
select distinct Product_ID from a_products except select Product_ID from a_order_products""")
def key_difference(t):
    """Products that were never ordered (set difference of keys)."""
    return setops.key_difference(adapters.products(t), adapters.order_items(t), "Product_ID")


@query("sorted_customers", sql="""
select Customer_ID, Total_Amount_Spent, Days_Since_Last_Order from a_customer360""")
def sorted_customers(t):
    """Customers by spend, largest first, missing values last."""
    df = c360.customer_360(t).select("Customer_ID", "Total_Amount_Spent", "Days_Since_Last_Order")
    return setops.sort_nulls_last(df, ["Total_Amount_Spent", "Customer_ID"], [False, True])


@query("train_median_fill", sql="""
with s as (select *, case when row_number() over (partition by Churn order by md5(cast(Customer_ID as varchar)), Customer_ID)
  <= floor(count(*) over (partition by Churn) * 0.2 + 0.5) then 'test' else 'train' end as split from a_churn),
m as (select median(Order_Amount_Hike_From_Last_Year) as med from s where split = 'train')
select Customer_ID, coalesce(cast(Order_Amount_Hike_From_Last_Year as double), m.med) as Order_Amount_Hike_From_Last_Year
from s, m where split = 'test'""")
def train_median_fill(t):
    """Gaps of the test part filled with medians fitted on the training part."""
    raw = adapters.churn(t)
    split = sampling.stratified_split(raw, "Customer_ID", "Churn", 0.2)
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    med = clean.column_medians(train, ["Order_Amount_Hike_From_Last_Year"])
    filled = clean.fill_median(test, ["Order_Amount_Hike_From_Last_Year"], medians=med)
    return filled.select("Customer_ID", "Order_Amount_Hike_From_Last_Year")


@query("format_audit_dates", sql="""
with d as (select cast(o_orderdate as varchar) as order_date,
  case when o_orderkey % 97 = 0 then 'not a date' else cast(o_orderdate as varchar) end as ship_date_text from orders)
select 'order_date' as column, 'date_parse' as "check",
  count(*) filter (where order_date is not null and try_cast(order_date as timestamp) is null) as bad_rows,
  case when count(*) filter (where order_date is not null and try_cast(order_date as timestamp) is null) = 0
       then 'ok' else 'invalid' end as status from d
union all
select 'ship_date_text', 'date_parse',
  count(*) filter (where ship_date_text is not null and try_cast(ship_date_text as timestamp) is null),
  case when count(*) filter (where ship_date_text is not null and try_cast(ship_date_text as timestamp) is null) = 0
       then 'ok' else 'invalid' end from d""")
def format_audit_dates(t):
    """Date-named text columns checked by a lenient timestamp parse."""
    d = t.orders.select(F.col("o_orderdate").cast("string").alias("order_date"),
                        F.when(F.col("o_orderkey") % 97 == 0, F.lit("not a date"))
                        .otherwise(F.col("o_orderdate").cast("string")).alias("ship_date_text"))
    return clean.format_audit(d)
