"""Registered queries: audit log (L1-L3), data-quality audit (P10-P13, P19) and the streams beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..session import cut_lineage, scratch_path
from ..sources import adapters, io
from ..streaming import audit_stream, upload_stream
from .catalog import query


@query("audit_overview", sql="""
select count(*) as total_events, count(*) filter (where action_type = 'upload') as uploads,
  count(*) filter (where action_type = 'download') as downloads,
  count(*) filter (where action_type = 'run_analysis') as analyses_run from a_audit""")
def audit_overview(t):
    """L1: event counts of the audit log."""
    return audit.audit_overview(adapters.audit_logs(t))


@query("audit_filtered", sql="""
select "timestamp", user_email, role, action_type, page_name, file_name, details from a_audit
where organization_id = '1' and action_type = 'download' and page_name = 'page2'
order by "timestamp" desc""")
def audit_filtered(t):
    """L2: one organisation's downloads on one page, newest first."""
    return audit.audit_filtered(adapters.audit_logs(t), "1",
                                {"user_email": "All", "action_type": "download", "page_name": "page2"})


@query("audit_filters", sql="""
select distinct 'user_email' as filter, user_email as value from a_audit where user_email is not null
union select 'action_type', action_type from a_audit where action_type is not null
union select 'page_name', page_name from a_audit where page_name is not null""")
def audit_filters(t):
    """L3: values offered by the three filters."""
    return audit.audit_filter_values(adapters.audit_logs(t))


_CHURN_COLS = ["Customer_ID", "Preferred_Login_Device", "City_Tier", "Preferred_Payment_Mode",
               "Hours_Spend_On_Website", "Total_Devices_Registered", "Satisfaction_Score",
               "Marital_Status", "Complain_Count_In_Last_Month", "Order_Amount_Hike_From_Last_Year",
               "Discount_Coupon_Used_Count", "Days_Since_Last_Order", "Average_Cash_Back", "Churn"]
_CHURN_NUM = [c for c in _CHURN_COLS if c not in ("Preferred_Login_Device", "Preferred_Payment_Mode",
                                                  "Hours_Spend_On_Website", "Marital_Status")]
_CHURN_TEXT = ["Preferred_Login_Device", "Preferred_Payment_Mode", "Hours_Spend_On_Website", "Marital_Status"]


def _quality_sql() -> str:
    parts = [f"select 'missing_pct' as \"check\", '{c}' as column, "
             f"cast(round_even(count(*) filter (where {c} is null) * 100.0 / count(*), 2) as varchar) as value from a_churn"
             for c in _CHURN_COLS]
    for c in _CHURN_TEXT:
        bad = f"count(*) filter (where {c} is not null and try_cast({c} as double) is null)"
        parts.append(f"select 'format:numeric_as_text', '{c}', 'stored_as_text:' || cast({bad} as varchar) "
                     f"from a_churn having {bad} = 0 and count({c}) > 0")
    for c in _CHURN_NUM:
        parts.append(
            f"select 'outliers', '{c}', cast(count(*) as varchar) from a_churn, "
            f"(select quantile_cont(cast({c} as double), [0.25, 0.75]) as q from a_churn) "
            f"where {c} < q[1] - 1.5 * (q[2] - q[1]) or {c} > q[2] + 1.5 * (q[2] - q[1]) having count(*) > 0")
    return " union all ".join(parts)


@query("quality_report", sql=_quality_sql())
def quality_report(t):
    """Data-quality audit of the raw churn source."""
    return audit.quality_report(adapters.churn(t))


@query("auto_preprocess", sql="""
select * replace (
  coalesce(Hours_Spend_On_Website, (select Hours_Spend_On_Website from a_churn where Hours_Spend_On_Website is not null
     group by 1 order by count(*) desc, 1 limit 1)) as Hours_Spend_On_Website,
  coalesce(cast(Order_Amount_Hike_From_Last_Year as double), (select median(Order_Amount_Hike_From_Last_Year) from a_churn))
     as Order_Amount_Hike_From_Last_Year),
  'Auto_Validated_v2' as data_lineage, timestamp '2024-01-01 00:00:00' as audit_timestamp
from (select distinct * from a_churn)""")
def auto_preprocess(t):
    """Gaps filled (median / mode), duplicates dropped, lineage stamped."""
    data, _ = audit.auto_preprocess(adapters.churn(t), when="2024-01-01 00:00:00")
    return data


@query("running_overview", sql="""
select organization_id, count(*) as total_events, count(*) filter (where action_type = 'upload') as uploads,
  count(*) filter (where action_type = 'download') as downloads, count(*) filter (where action_type = 'run_analysis') as analyses_run
from a_audit where organization_id is not null group by 1""")
def running_overview(t):
    """L1/A15 as a stream: the log lands in two halves, and two runs of the query keep the counts of each organisation."""
    base = scratch_path(t.spark, "overview")
    events = adapters.audit_logs(t)
    half = F.pmod(F.xxhash64("timestamp", "user_email"), F.lit(2))
    for k in (0, 1):
        io.write_json(events.where(half == k), f"{base}/landing/{k}")
        stream = audit_stream.audit_events_stream(t.spark, f"{base}/landing/*")
        upload_stream.start_overview(stream, f"{base}/table", f"{base}/checkpoint", lateness="10000 days").awaitTermination()
    return upload_stream.read_overview(t.spark, f"{base}/table")


@query("uploads_once", sql="select c_custkey, c_name, c_mktsegment from customer")
def uploads_once(t):
    """S9 as a stream: the customer file lands three times, before and after a restart, and is taken once."""
    base = scratch_path(t.spark, "uploads")
    rows = cut_lineage(t.customer.select("c_custkey", "c_name", "c_mktsegment"))
    for names in (("first", "again"), ("later",)):
        for name in names:
            rows.write.csv(f"{base}/landing/{name}")
        upload_stream.start_uploads(t.spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint",
                                    "c_custkey long, c_name string, c_mktsegment string").awaitTermination()
    return t.spark.read.parquet(f"{base}/table").drop("trigger")
