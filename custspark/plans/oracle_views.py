"""DuckDB text of the reference-shaped views, for oracle SQL.

Each registered query may carry an ANSI-SQL twin that DuckDB runs on the
same parquet tables.  The twins share these common table expressions,
which restate :mod:`custspark.sources.adapters` in SQL (prefixed ``a_`` so
they never shadow a base table).
"""

from __future__ import annotations

DD = "cast(date_diff('day', max(o_orderdate), (select max(o_orderdate) from orders)) as integer)"

VIEW_CTES = {
    "a_orders": "select o_orderkey as Order_ID, o_custkey as Customer_ID from orders",
    "a_order_products": """
        select l.l_orderkey as Order_ID, l.l_partkey as Product_ID,
          case when row_number() over (partition by o.o_custkey, p.p_brand
               order by o.o_orderdate, o.o_orderkey, l.l_linenumber, l.l_partkey) > 1
               then 1 else 0 end as Was_Product_Reordered
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey
        join part p on l.l_partkey = p.p_partkey""",
    "a_products": """select p_partkey as Product_ID, p_name as Product_Name,
        cast(substr(p_brand, 7) as int) as Department_ID from part""",
    "a_departments": """select distinct cast(substr(p_brand, 7) as int) as Department_ID,
        p_brand as Department_Name from part""",
    "a_basket_lines": """select l.l_orderkey as Order_ID, p.p_type as Department_Name
        from lineitem l join part p on l.l_partkey = p.p_partkey""",
    "a_purchases": """
        select o.o_custkey as Customer_ID, l.l_extendedprice * (1 - l.l_discount) as Amount_Spent,
          18 + o.o_custkey % 50 + case when l.l_linenumber = 1 then 1 else 0 end as Customer_Age,
          case when l.l_returnflag = 'R' then 1 else 0 end as Order_Returns
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "rec": f"""select o_custkey as Customer_ID, {DD} as Days_Since_Last_Order,
        count(*) as Total_Orders_This_Month, round(sum(o_totalprice), 6) as Total_Amount_Spent
        from orders group by o_custkey""",
    "a_churn": """
        select c.c_custkey as Customer_ID,
          case c.c_custkey % 3 when 0 then 'Phone' when 1 then 'Mobile Phone' else 'Computer' end as Preferred_Login_Device,
          1 + c.c_nationkey % 3 as City_Tier, c.c_mktsegment as Preferred_Payment_Mode,
          case when c.c_custkey % 11 = 0 then null else concat(cast(c.c_custkey % 5 as varchar), 'h') end as Hours_Spend_On_Website,
          1 + c.c_custkey % 6 as Total_Devices_Registered, 1 + (c.c_custkey * 7) % 5 as Satisfaction_Score,
          case c.c_custkey % 3 when 0 then 'Single' when 1 then 'Married' else 'Divorced' end as Marital_Status,
          case when c.c_custkey % 4 = 0 then 1 else 0 end as Complain_Count_In_Last_Month,
          case when c.c_custkey % 13 = 0 then null else 11 + c.c_custkey % 16 end as Order_Amount_Hike_From_Last_Year,
          c.c_custkey % 8 as Discount_Coupon_Used_Count, r.Days_Since_Last_Order,
          abs(c.c_acctbal) / 20 as Average_Cash_Back,
          case when r.Days_Since_Last_Order > 365 then 1 else 0 end as Churn
        from customer c join rec r on c.c_custkey = r.Customer_ID""",
    "a_cltv": """
        select c.c_custkey as Customer_ID,
          case c.c_custkey % 2 when 0 then 'Urban' else 'Rural' end as Customer_Residence_Type,
          case c.c_custkey % 3 when 0 then 'Platinum' when 1 then 'Gold' else 'Silver' end as Membership_Type,
          case c.c_custkey % 4 when 0 then '<=2L' when 1 then '2L-5L' when 2 then '5L-10L' else 'More than 10L' end as Customer_Income,
          case c.c_custkey % 2 when 0 then 'F' else 'M' end as Customer_Gender,
          case c.c_custkey % 3 when 0 then 'Bachelor' when 1 then 'High School' else 'Others' end as Customer_Qualification,
          case when c.c_custkey % 3 = 0 then '1' else 'More than 1' end as Total_Subscriptions,
          (c.c_custkey * 37) % 10000 as Loyalty_Engagement_Score,
          r.Total_Amount_Spent / 10 as Customer_Live_Time_Value
        from customer c join rec r on c.c_custkey = r.Customer_ID""",
    "a_green": """
        select c_custkey as Customer_ID,
          case c_custkey % 4 when 0 then 'Search' when 1 then 'Social' when 2 then 'Ads' else 'Direct' end as Referral_Source,
          1 + c_custkey % 10 as Cultural_Eco_Alignment, 1 + (c_custkey * 3) % 10 as Emotional_Guilt_Score,
          1 + (c_custkey * 7) % 10 as Emotional_Pride_Score, 1 + (c_custkey * 9) % 10 as Social_Influence_Score,
          1 + (c_custkey * 11) % 10 as Green_Knowledge_Level,
          case when c_custkey % 17 = 0 then null else cast((c_custkey * 13) % 60 as double) / 2 end as Time_Spent_on_Green_Products,
          (c_custkey * 17) % 20 as Clicks_on_Green_Products, (c_custkey * 19) % 8 as Previous_Green_Purchases,
          cast((c_custkey * 31) % 101 as double) / 100 as Green_Consumption_Score,
          case when (c_custkey * 31) % 101 >= 40 then 1 else 0 end as Green_Purchase_Made
        from customer""",
    "a_audit": """
        select concat('user', cast(user_id as varchar), '@example.org') as user_email,
          case when user_id % 5 = 0 then 'admin' else 'analyst' end as role,
          cast(user_id % 3 as varchar) as organization_id,
          case event_type when 'view' then 'run_analysis' when 'click' then 'download'
               when 'signup' then 'upload' else event_type end as action_type,
          concat('page', cast(event_id % 4 as varchar)) as page_name,
          cast(null as varchar) as file_name, cast(null as varchar) as details,
          ts as "timestamp"
        from events""",
    # cleaned churn: P6, P7, P8 (median fill, truncation), P5
    "a_churn_num": """
        select * replace (
          case when Preferred_Login_Device = 'Phone' then 'Mobile Phone' else Preferred_Login_Device end as Preferred_Login_Device,
          try_cast(nullif(regexp_replace(Hours_Spend_On_Website, '[^0-9.]', '', 'g'), '') as double) as Hours_Spend_On_Website,
          cast(Order_Amount_Hike_From_Last_Year as double) as Order_Amount_Hike_From_Last_Year,
          cast(Discount_Coupon_Used_Count as double) as Discount_Coupon_Used_Count,
          cast(Days_Since_Last_Order as double) as Days_Since_Last_Order,
          cast(Average_Cash_Back as double) as Average_Cash_Back,
          cast(Total_Devices_Registered as double) as Total_Devices_Registered,
          cast(Satisfaction_Score as double) as Satisfaction_Score)
        from a_churn""",
    "a_churn_med": """
        select median(Hours_Spend_On_Website) h, median(Order_Amount_Hike_From_Last_Year) o,
          median(Discount_Coupon_Used_Count) d, median(Days_Since_Last_Order) s,
          median(Average_Cash_Back) a, median(Total_Devices_Registered) t, median(Satisfaction_Score) q
        from a_churn_num""",
    "a_churn_clean": """
        select Customer_ID, Preferred_Login_Device, City_Tier, Preferred_Payment_Mode,
          cast(trunc(coalesce(Hours_Spend_On_Website, m.h)) as bigint) as Hours_Spend_On_Website,
          cast(trunc(coalesce(Total_Devices_Registered, m.t)) as bigint) as Total_Devices_Registered,
          cast(trunc(coalesce(Satisfaction_Score, m.q)) as bigint) as Satisfaction_Score,
          Marital_Status, Complain_Count_In_Last_Month,
          cast(trunc(coalesce(Order_Amount_Hike_From_Last_Year, m.o)) as bigint) as Order_Amount_Hike_From_Last_Year,
          cast(trunc(coalesce(Discount_Coupon_Used_Count, m.d)) as bigint) as Discount_Coupon_Used_Count,
          cast(trunc(coalesce(Days_Since_Last_Order, m.s)) as bigint) as Days_Since_Last_Order,
          coalesce(Average_Cash_Back, m.a) as Average_Cash_Back, Churn
        from a_churn_num, a_churn_med m
        where (case when Preferred_Payment_Mode is null then 1 else 0 end
             + case when Marital_Status is null then 1 else 0 end) < 2""",
    "a_cltv_clean": "select * replace (replace(Customer_Income, 'L', 'K') as Customer_Income) from a_cltv",
    "a_purchase_agg": """
        select Customer_ID, arg_max(Customer_Age, n * 1000000 - Customer_Age) as Customer_Age,
          round(sum(s), 6) as Total_Amount_Spent, cast(sum(r) as bigint) as Total_Returns
        from (select Customer_ID, Customer_Age, count(*) as n, sum(Amount_Spent) as s, sum(Order_Returns) as r
              from a_purchases group by 1, 2) group by 1""",
    "a_pref_dept": """
        select Customer_ID, Preferred_Order_Category, d.Department_Name as Preferred_Order_Category_Name
        from (select Customer_ID, arg_max(Department_ID, cnt * 1000000 - Department_ID) as Preferred_Order_Category
              from (select o.Customer_ID, p.Department_ID, count(*) as cnt
                    from a_orders o join a_order_products op on o.Order_ID = op.Order_ID
                    join a_products p on op.Product_ID = p.Product_ID group by 1, 2) group by 1) x
        left join a_departments d on x.Preferred_Order_Category = d.Department_ID""",
    "a_customer360": """
        select c.*, v.* exclude (Customer_ID), pa.* exclude (Customer_ID),
          coalesce(cast(pd.Preferred_Order_Category as varchar), 'Unknown') as Preferred_Order_Category,
          coalesce(pd.Preferred_Order_Category_Name, 'Unknown') as Preferred_Order_Category_Name,
          cast(coalesce(oc.n, 0) as bigint) as Total_Orders_This_Month
        from a_churn_clean c join a_cltv_clean v on c.Customer_ID = v.Customer_ID
        join a_purchase_agg pa on c.Customer_ID = pa.Customer_ID
        left join a_pref_dept pd on c.Customer_ID = pd.Customer_ID
        left join (select Customer_ID, count(*) n from a_orders group by 1) oc on c.Customer_ID = oc.Customer_ID""",
}


def with_views(body: str) -> str:
    """Prefix a query body with every view CTE (DuckDB inlines only the
    ones referenced).  A body that starts with its own ``WITH`` is merged."""
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in VIEW_CTES.items())
    b = body.strip()
    if b[:5].lower() == "with ":
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{b}"
