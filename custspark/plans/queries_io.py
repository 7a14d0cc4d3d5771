"""Registered queries: sources and sinks (S1, S2, S4, S6, S7, S9) and the
streaming audit ingest.  Each writes the given rows to a fresh folder
under the shared checkpoint folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters, io
from ..streaming import audit_stream
from .catalog import query

_PURCHASE_SCHEMA = "Customer_ID long, Amount_Spent double, Customer_Age long, Order_Returns int"


@query("csv_roundtrip_counts", sql="""
select count(*) as rows, count(distinct Customer_ID) as customers, cast(sum(Order_Returns) as bigint) as returns
from a_purchases""")
def csv_roundtrip_counts(t):
    """S4 then S1: transactions written as CSV and read back with a schema."""
    path = io.unique_scratch(t.spark, "purchases-csv")
    io.write_csv(adapters.purchases(t), path)
    back = io.read_csv(t.spark, path, _PURCHASE_SCHEMA)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("Customer_ID").alias("customers"),
                    F.sum("Order_Returns").alias("returns"))


@query("json_roundtrip", sql="""
select user_email, action_type, page_name, "timestamp" from a_audit""")
def json_roundtrip(t):
    """Audit events as JSON lines, read back with a schema."""
    path = io.unique_scratch(t.spark, "audit-json")
    io.write_json(adapters.audit_logs(t), path)
    back = io.read_json(t.spark, path, schema=io.AUDIT_SCHEMA)
    return back.select("user_email", "action_type", "page_name", "timestamp")


@query("audit_partition_read", sql="""
select user_email, role, action_type, page_name, "timestamp" from a_audit where organization_id = '2'""")
def audit_partition_read(t):
    """Events appended partitioned by organisation; one organisation read (pruned)."""
    path = io.unique_scratch(t.spark, "audit-table")
    io.append_audit(adapters.audit_logs(t), path)
    return io.read_audit(t.spark, path, "2").select("user_email", "role", "action_type", "page_name", "timestamp")


@query("audit_stream_ingest", sql="""
select organization_id, count(*) as events, count(*) filter (where action_type = 'upload') as uploads
from a_audit group by 1""")
def audit_stream_ingest(t):
    """Structured Streaming: JSON landing folder -> partitioned audit table."""
    landing = io.unique_scratch(t.spark, "audit-landing")
    table = io.unique_scratch(t.spark, "audit-stream-table")
    ckpt = io.unique_scratch(t.spark, "audit-stream-ckpt")
    io.write_json(adapters.audit_logs(t), landing)
    q = audit_stream.start_ingest(t.spark, landing, table, ckpt, available_now=True)
    q.awaitTermination()
    back = io.read_audit(t.spark, table)
    return back.groupBy("organization_id").agg(F.count(F.lit(1)).alias("events"),
                                               F.count_if(F.col("action_type") == "upload").alias("uploads"))


@query("table_fingerprint")
def table_fingerprint(t):
    """Order-insensitive fingerprint of the order table."""
    return io.fingerprint(t.orders)


@query("audit_export", sql="""
select "timestamp", user_email, role, action_type, page_name, file_name, details from a_audit
where organization_id = '0' and action_type = 'upload'""")
def audit_export(t):
    """L4: the filtered audit log exported as CSV (one file per task) and read back."""
    from ..operators import audit
    path = io.unique_scratch(t.spark, "audit-export")
    io.write_csv(audit.audit_filtered(adapters.audit_logs(t), "0", {"action_type": "upload"}), path)
    return io.read_csv(t.spark, path, "timestamp timestamp_ntz, user_email string, role string, action_type string, "
                                      "page_name string, file_name string, details string")
