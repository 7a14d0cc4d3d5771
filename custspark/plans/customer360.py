"""One row per customer (A1, J1-J5, W1, F1-F3, cleaning of the sources).

    churn --clean--\\
    cltv  --clean---+-- inner on Customer_ID --+-- left: preferred department
    purchases --A1-/                           +-- left: orders per customer

Every step is a grouped aggregate or an equi-join on ``Customer_ID``;
aggregates run before joins so that each join sees one row per customer
on its right side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..operators import clean
from ..operators.sampling import majority_downsample
from ..sources import adapters
from ..sources.tables import Tables

# The churn source's columns and its numeric columns.
CHURN_COLUMNS = ["Customer_ID", "Preferred_Login_Device", "City_Tier", "Preferred_Payment_Mode",
                 "Hours_Spend_On_Website", "Total_Devices_Registered", "Satisfaction_Score", "Marital_Status",
                 "Complain_Count_In_Last_Month", "Order_Amount_Hike_From_Last_Year", "Discount_Coupon_Used_Count",
                 "Days_Since_Last_Order", "Average_Cash_Back", "Churn"]
CHURN_NUMERIC = ["Hours_Spend_On_Website", "Order_Amount_Hike_From_Last_Year",
                 "Discount_Coupon_Used_Count", "Days_Since_Last_Order", "Average_Cash_Back",
                 "Total_Devices_Registered", "Satisfaction_Score"]


def clean_churn(churn: DataFrame, cap: int | None = None) -> DataFrame:
    """Churn source cleaning: merge device spellings (P6), coerce the numeric
    columns (P7), median fill (P8), whole numbers except cash back, keep
    rows with fewer than two gaps (P5), optional majority down-sampling to
    ``cap`` rows (W5), target last (P3).  Extra columns pass through."""
    df = clean.merge_categories(churn, "Preferred_Login_Device", {"Phone": "Mobile Phone"})
    df = clean.coerce_numeric(df, CHURN_NUMERIC)
    df = clean.fill_median(df, CHURN_NUMERIC)
    df = clean.truncate_to_long(df, [c for c in CHURN_NUMERIC if c != "Average_Cash_Back"])
    df = clean.keep_rows_with_few_nulls(df, 2, [c for c in CHURN_COLUMNS if c in df.columns])
    if cap is not None:
        df = majority_downsample(df, "Customer_ID", "Churn", cap)
    return clean.target_last(df, "Churn")


def clean_cltv(cltv: DataFrame) -> DataFrame:
    """Value source cleaning: income bands spell lakh as K."""
    return cltv.withColumn("Customer_Income", fx.replace_letter("Customer_Income", "L", "K"))


def purchase_rollup(purchases: DataFrame) -> DataFrame:
    """A1: per customer the modal age (ties to the smallest), total spend and
    total returns.  ``mode`` is a partial aggregate, so the value counts are
    combined map-side before the shuffle."""
    return (purchases.groupBy("Customer_ID")
            .agg(F.mode("Customer_Age", True).alias("Customer_Age"),
                 # line amounts carry 4 decimals: rounding the sum to 6 drops
                 # only summation-order noise
                 F.round(F.sum("Amount_Spent"), 6).alias("Total_Amount_Spent"),
                 F.sum("Order_Returns").alias("Total_Returns")))


def preferred_department(orders: DataFrame, order_products: DataFrame, products: DataFrame,
                         departments: DataFrame) -> DataFrame:
    """The department a customer bought most often; ties go to the
    lowest department id (the stable sort of the original).  One grouped
    ``mode`` (deterministic: smallest of the most frequent): its per-customer
    value->count map combines map-side, so there is no per-customer sort and
    no hot task for a customer with most of the lines."""
    lines = (orders.select("Customer_ID", "Order_ID")
             .join(order_products.select("Order_ID", "Product_ID"), "Order_ID")
             .join(products.select("Product_ID", "Department_ID"), "Product_ID"))
    best = lines.groupBy("Customer_ID").agg(F.mode("Department_ID", True).alias("Preferred_Order_Category"))
    names = departments.select(F.col("Department_ID").alias("Preferred_Order_Category"),
                               F.col("Department_Name").alias("Preferred_Order_Category_Name"))
    return best.join(names, "Preferred_Order_Category", "left").select(
        "Customer_ID", "Preferred_Order_Category", "Preferred_Order_Category_Name")


def orders_per_customer(orders: DataFrame) -> DataFrame:
    """A3: order count per customer."""
    return orders.groupBy("Customer_ID").agg(F.count(F.lit(1)).alias("Total_Orders_This_Month"))


def line_rollup(t: Tables) -> DataFrame:
    """Purchase roll-up (A1) and preferred department (W1) in ONE aggregate
    over the order lines: modal age, spend and returns, and the modal
    department (``mode`` with ties to the smallest value is exactly "most
    lines, lowest id first").  ``mode`` keeps a small value->count map per
    customer and merges it map-side, so a customer holding a large share of
    all lines is reduced before the shuffle.  Lines whose product has no
    department still count for spend, not for the department."""
    pc = adapters.purchase_columns()
    dept = adapters.products(t).select(F.col("Product_ID").alias("l_partkey"), "Department_ID")
    lines = adapters.order_lines(t).join(dept, "l_partkey", "left")
    return lines.groupBy(pc["Customer_ID"].alias("Customer_ID")).agg(
        F.mode(pc["Customer_Age"], True).alias("Customer_Age"),
        F.round(F.sum(pc["Amount_Spent"]), 6).alias("Total_Amount_Spent"),
        F.sum(pc["Order_Returns"]).alias("Total_Returns"),
        F.mode(F.col("Department_ID"), True).alias("Preferred_Order_Category"))


def customer_360(t: Tables, churn_cap: int | None = None) -> DataFrame:
    """The wide customer table of the profiling step.

    Churn and value attributes are projections of one customer x recency
    join, so they are derived side by side instead of being joined back
    together; purchase and department figures are one aggregate over the
    order lines.  Shuffles: orders by customer (recency), lines by order
    (join with orders) and by part (department), line roll-up by customer,
    and the customer-level joins (small sides broadcast by AQE)."""
    # customer x recency is read by the median fit (two passes) and by the
    # main plan: checkpointed once, so the order table is aggregated once
    from ..session import cut_lineage
    base = cut_lineage(adapters.customer_base(t))
    wide = base.select(*adapters.churn_columns(), *adapters.cltv_columns(with_id=False),
                       "Total_Orders_This_Month")
    wide = clean_cltv(clean_churn(wide, churn_cap))
    names = adapters.departments(t).select(F.col("Department_ID").alias("Preferred_Order_Category"),
                                           F.col("Department_Name").alias("Preferred_Order_Category_Name"))
    lines = line_rollup(t).join(names, "Preferred_Order_Category", "left")
    merged = wide.join(lines, "Customer_ID")
    merged = clean.fill_constant(merged, {"Preferred_Order_Category": "Unknown",
                                          "Preferred_Order_Category_Name": "Unknown"})
    return merged.withColumn("Total_Orders_This_Month",
                             F.coalesce(F.col("Total_Orders_This_Month"), F.lit(0)).cast("long"))


def merge_sources(churn: DataFrame, cltv: DataFrame, purchases: DataFrame, orders: DataFrame,
                  order_products: DataFrame, products: DataFrame, departments: DataFrame) -> DataFrame:
    """The same table from separately delivered sources (J1, J3, A1, A3, W1):
    inner joins of the customer-level sources, left joins of the derived
    figures."""
    merged = churn.join(cltv, "Customer_ID").join(purchase_rollup(purchases), "Customer_ID")
    pref = preferred_department(orders, order_products, products, departments)
    merged = merged.join(pref, "Customer_ID", "left")
    merged = clean.fill_constant(merged, {"Preferred_Order_Category": "Unknown",
                                          "Preferred_Order_Category_Name": "Unknown"})
    merged = merged.join(orders_per_customer(orders), "Customer_ID", "left")
    return merged.withColumn("Total_Orders_This_Month",
                             F.coalesce(F.col("Total_Orders_This_Month"), F.lit(0)).cast("long"))


def segmentation_features(df: DataFrame) -> DataFrame:
    """F1-F3 on the customer table."""
    return df.withColumns({
        "Purchase_Intensity": fx.purchase_intensity(),
        "Recency": fx.recency(),
        "Avg_Spend_Per_Order": fx.avg_spend_per_order(),
    })


def customer_360_materialized(t: Tables, churn_cap: int | None = None) -> DataFrame:
    """The customer table written once to the shared checkpoint folder.
    Operators that read it several times (quantile passes, statistics
    followed by the main pass, model fits, lever statistics) then scan a
    customer-level file instead of re-running the order-line joins."""
    from ..session import cut_lineage
    return cut_lineage(customer_360(t, churn_cap))
