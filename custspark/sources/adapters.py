"""Reference-shaped views over the star-schema tables.

The analytics operators speak in customer / order / product terms
(``Customer_ID``, ``Order_ID``, ``Department_Name`` ...).  These builders
derive those tables from ``customer``, ``orders``, ``lineitem``, ``part``
and ``events``.  Attributes with no source column are fixed formulas of
the customer key, so the same rows come out of any engine.

Every builder is a lazy DataFrame; nothing is collected.  The global
"last order date" is a scalar subquery, evaluated once by Spark at run
time and never pulled into Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import shuffle_width
from .tables import Tables


def _case_mod(key: Column, m: int, values: list[str]) -> Column:
    """``case key % m when 0 then values[0] ...`` as a nested ``when``."""
    r = key % F.lit(m)
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(r == i, F.lit(values[i])).otherwise(out)
    return out


def orders(t: Tables) -> DataFrame:
    """One row per order."""
    return t.orders.select(F.col("o_orderkey").alias("Order_ID"),
                           F.col("o_custkey").alias("Customer_ID"))


def order_products(t: Tables, with_department: bool = False) -> DataFrame:
    """One row per order line; ``Was_Product_Reordered`` = the customer bought
    this brand on an earlier line (``with_department`` keeps the brand as
    ``Department_Name``).  The first line per (customer, brand) is
    found with a grouped ``min`` of the ordering tuple (partial aggregation,
    so a customer holding a large share of all lines is still combined
    map-side) and then joined back, instead of a window that would sort a
    whole customer inside one task."""
    # (date, order, line number, part) may tie; the remaining line columns
    # break ties so that exactly one line per (customer, brand) is first
    tie_breakers = ["l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                    "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = (t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", *tie_breakers)
             .join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"),
                   F.col("l_orderkey") == F.col("o_orderkey"))
             .join(t.part.select("p_partkey", "p_brand"),
                   F.col("l_partkey") == F.col("p_partkey")))
    order_key = F.struct("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", *tie_breakers)
    first = (lines.groupBy("o_custkey", "p_brand")
             .agg(F.min(order_key).alias("_first")))
    out = (lines.withColumn("_key", order_key)
           .join(first, ["o_custkey", "p_brand"])
           .select(F.col("l_orderkey").alias("Order_ID"),
                   F.col("l_partkey").alias("Product_ID"),
                   F.when(F.col("_key") == F.col("_first"), F.lit(0)).otherwise(F.lit(1))
                   .alias("Was_Product_Reordered"),
                   F.col("p_brand").alias("Department_Name")))
    # the brand is already joined for the flag; callers that want the
    # department name keep it instead of joining products and departments
    return out if with_department else out.drop("Department_Name")


#: Order lines that one task joins and counts; a larger table takes more tasks than the session's width gives.
TASK_LINES = 1 << 19


def _spread(df: DataFrame, width: int | None, *keys: str) -> DataFrame:
    return df.repartition(width, *keys) if width else df


def _brand_lines(t: Tables, width: int | None = None) -> DataFrame:
    return (_spread(t.lineitem.select("l_orderkey", "l_partkey"), width, "l_orderkey")
            .join(_spread(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), width, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .where(F.col("o_custkey").isNotNull() & F.col("p_brand").isNotNull()))


def brand_purchases(t: Tables) -> DataFrame:
    """One row per customer and brand: ``lines`` and ``reorders``.  All lines but a customer's first of a
    brand are re-orders, so their number needs no flag: one count, combined map-side."""
    return (_brand_lines(t).groupBy(F.col("o_custkey").alias("Customer_ID"), F.col("p_brand").alias("Department_Name"))
            .agg(F.count(F.lit(1)).alias("lines")).withColumn("reorders", F.col("lines") - 1))


def brand_orders(t: Tables) -> DataFrame:
    """One row per order and brand with ``Was_Product_Reordered``: 0 where the order holds nothing but
    the customer's first line of the brand.  The lines are counted by order and brand before
    the customer's first order of the brand (by date, then key) is looked for.  Nearly every line is a group
    of its own there, so tasks are as many as the lines ask for."""
    keys = ["o_custkey", "p_brand", "o_orderdate", "o_orderkey"]
    width = math.ceil(t.lineitem.count() / TASK_LINES)
    width = width if width > shuffle_width(t.lineitem.sparkSession) else None
    held = (_spread(_brand_lines(t, width), width, *keys).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("lines")))
    first = held.groupBy("o_custkey", "p_brand").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    is_first = F.struct("o_orderdate", "o_orderkey").eqNullSafe(F.col("first"))
    return (held.join(first, ["o_custkey", "p_brand"])
            .select(F.col("o_orderkey").alias("Order_ID"), F.col("p_brand").alias("Department_Name"),
                    F.when(is_first & (F.col("lines") == 1), F.lit(0)).otherwise(F.lit(1)).alias("Was_Product_Reordered")))


def order_items(t: Tables) -> DataFrame:
    """``order_products`` without the re-order flag: every order line as an
    (order, product) pair, for uses that do not need the flag (which costs a
    second pass over the lines).  ``order_products`` keeps only lines whose
    order and part exist, as its flag needs both; on the given tables every
    line has both."""
    return t.lineitem.select(F.col("l_orderkey").alias("Order_ID"), F.col("l_partkey").alias("Product_ID"))


def products(t: Tables) -> DataFrame:
    """One row per product; the department is the brand number."""
    return t.part.select(F.col("p_partkey").alias("Product_ID"),
                         F.col("p_name").alias("Product_Name"),
                         F.expr("substr(p_brand, 7)").cast("int").alias("Department_ID"))


def departments(t: Tables) -> DataFrame:
    """One row per department."""
    return (t.part.select(F.expr("substr(p_brand, 7)").cast("int").alias("Department_ID"),
                          F.col("p_brand").alias("Department_Name"))
            .distinct())


def basket_lines(t: Tables) -> DataFrame:
    """One row per order line with the item type as the basket item."""
    return (t.lineitem.select("l_orderkey", "l_partkey")
            .join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("Order_ID"),
                    F.col("p_type").alias("Department_Name")))


def purchase_columns() -> dict[str, Column]:
    """Transaction attributes of an order line joined to its order."""
    return {"Customer_ID": F.col("o_custkey"),
            "Amount_Spent": F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")),
            "Customer_Age": (F.lit(18) + F.col("o_custkey") % 50
                             + F.when(F.col("l_linenumber") == 1, F.lit(1)).otherwise(F.lit(0))),
            "Order_Returns": F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(0))}


def order_lines(t: Tables) -> DataFrame:
    """Order lines joined to their order (one join, shared by the purchase
    and department figures)."""
    return (t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount",
                              "l_linenumber", "l_returnflag")
            .join(t.orders.select("o_orderkey", "o_custkey"),
                  F.col("l_orderkey") == F.col("o_orderkey")))


def purchases(t: Tables) -> DataFrame:
    """One row per transaction (order line)."""
    return order_lines(t).select(*[c.alias(n) for n, c in purchase_columns().items()])


def last_order_date(t: Tables) -> Column:
    """Scalar subquery: the latest order timestamp of the whole table."""
    return t.orders.agg(F.max("o_orderdate")).scalar()


def recency(t: Tables) -> DataFrame:
    """One row per customer: days since the last order, order count, spend."""
    ref = last_order_date(t)
    return (t.orders.groupBy(F.col("o_custkey").alias("Customer_ID"))
            .agg(F.datediff(ref, F.max("o_orderdate")).alias("Days_Since_Last_Order"),
                 F.count(F.lit(1)).alias("Total_Orders_This_Month"),
                 # rounded to 6 places: the exact sum has 2, so this only
                 # removes summation-order noise and makes engines agree bitwise
                 F.round(F.sum("o_totalprice"), 6).alias("Total_Amount_Spent")))


def customer_base(t: Tables) -> DataFrame:
    """One row per customer with orders: customer columns next to recency
    figures.  ``churn`` and ``cltv`` are projections of this one join."""
    c = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return c.join(recency(t), F.col("c_custkey") == F.col("Customer_ID")).drop("Customer_ID")


def churn_columns() -> list[Column]:
    """Churn attributes, with gaps and dirty text as in the raw file."""
    k = F.col("c_custkey")
    return [k.alias("Customer_ID"),
            _case_mod(k, 3, ["Phone", "Mobile Phone", "Computer"]).alias("Preferred_Login_Device"),
            (F.lit(1) + F.col("c_nationkey") % 3).alias("City_Tier"),
            F.col("c_mktsegment").alias("Preferred_Payment_Mode"),
            F.when(k % 11 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat((k % 5).cast("string"), F.lit("h"))).alias("Hours_Spend_On_Website"),
            (F.lit(1) + k % 6).alias("Total_Devices_Registered"),
            (F.lit(1) + (k * 7) % 5).alias("Satisfaction_Score"),
            _case_mod(k, 3, ["Single", "Married", "Divorced"]).alias("Marital_Status"),
            F.when(k % 4 == 0, F.lit(1)).otherwise(F.lit(0)).alias("Complain_Count_In_Last_Month"),
            F.when(k % 13 == 0, F.lit(None).cast("long")).otherwise(F.lit(11) + k % 16)
            .alias("Order_Amount_Hike_From_Last_Year"),
            (k % 8).alias("Discount_Coupon_Used_Count"),
            F.col("Days_Since_Last_Order"),
            (F.abs(F.col("c_acctbal")) / F.lit(20)).alias("Average_Cash_Back"),
            F.when(F.col("Days_Since_Last_Order") > 365, F.lit(1)).otherwise(F.lit(0)).alias("Churn")]


def cltv_columns(with_id: bool = True) -> list[Column]:
    """Membership attributes and lifetime value."""
    k = F.col("c_custkey")
    cols = [k.alias("Customer_ID")] if with_id else []
    return cols + [
        _case_mod(k, 2, ["Urban", "Rural"]).alias("Customer_Residence_Type"),
        _case_mod(k, 3, ["Platinum", "Gold", "Silver"]).alias("Membership_Type"),
        _case_mod(k, 4, ["<=2L", "2L-5L", "5L-10L", "More than 10L"]).alias("Customer_Income"),
        _case_mod(k, 2, ["F", "M"]).alias("Customer_Gender"),
        _case_mod(k, 3, ["Bachelor", "High School", "Others"]).alias("Customer_Qualification"),
        F.when(k % 3 == 0, F.lit("1")).otherwise(F.lit("More than 1")).alias("Total_Subscriptions"),
        ((k * 37) % 10000).alias("Loyalty_Engagement_Score"),
        (F.col("Total_Amount_Spent") / F.lit(10)).alias("Customer_Live_Time_Value")]


def churn(t: Tables) -> DataFrame:
    """One row per customer, with gaps and dirty text as in the raw file."""
    return customer_base(t).select(*churn_columns())


def cltv(t: Tables) -> DataFrame:
    """One row per customer: membership attributes and lifetime value."""
    return customer_base(t).select(*cltv_columns())


def green(t: Tables) -> DataFrame:
    """One row per customer: green-purchase attitudes, score and flag."""
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("Customer_ID"),
        _case_mod(k, 4, ["Search", "Social", "Ads", "Direct"]).alias("Referral_Source"),
        (F.lit(1) + k % 10).alias("Cultural_Eco_Alignment"),
        (F.lit(1) + (k * 3) % 10).alias("Emotional_Guilt_Score"),
        (F.lit(1) + (k * 7) % 10).alias("Emotional_Pride_Score"),
        (F.lit(1) + (k * 9) % 10).alias("Social_Influence_Score"),
        (F.lit(1) + (k * 11) % 10).alias("Green_Knowledge_Level"),
        F.when(k % 17 == 0, F.lit(None).cast("double"))
        .otherwise(((k * 13) % 60).cast("double") / F.lit(2)).alias("Time_Spent_on_Green_Products"),
        ((k * 17) % 20).alias("Clicks_on_Green_Products"),
        ((k * 19) % 8).alias("Previous_Green_Purchases"),
        (((k * 31) % 101).cast("double") / F.lit(100)).alias("Green_Consumption_Score"),
        F.when((k * 31) % 101 >= 40, F.lit(1)).otherwise(F.lit(0)).alias("Green_Purchase_Made"))


def audit_logs(t: Tables) -> DataFrame:
    """One row per audit event, from ``events``."""
    e = F.col("event_type")
    return t.events.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("user_email"),
        F.when(F.col("user_id") % 5 == 0, F.lit("admin")).otherwise(F.lit("analyst")).alias("role"),
        (F.col("user_id") % 3).cast("string").alias("organization_id"),
        F.when(e == "view", F.lit("run_analysis")).when(e == "click", F.lit("download"))
        .when(e == "signup", F.lit("upload")).otherwise(e).alias("action_type"),
        F.concat(F.lit("page"), (F.col("event_id") % 4).cast("string")).alias("page_name"),
        F.lit(None).cast("string").alias("file_name"),
        F.lit(None).cast("string").alias("details"),
        F.col("ts").alias("timestamp"))
