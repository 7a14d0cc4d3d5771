"""Audit log queries and the data-quality audit of an uploaded table
(L1-L4, P10, P12, P13, P19, A19, A27).

The audit log is an append-only Parquet table partitioned by
``organization_id`` (see :mod:`custspark.sources.io`), so reading one
organisation prunes every other partition.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clean, profile

LOG_COLUMNS = ["timestamp", "user_email", "role", "action_type", "page_name", "file_name", "details"]
FILTER_COLUMNS = ["user_email", "action_type", "page_name"]


def audit_overview(logs: DataFrame) -> DataFrame:
    """Total events, uploads, downloads, analyses run."""
    a = F.col("action_type")
    return logs.agg(F.count(F.lit(1)).alias("total_events"),
                    F.count_if(a == "upload").alias("uploads"),
                    F.count_if(a == "download").alias("downloads"),
                    F.count_if(a == "run_analysis").alias("analyses_run"))


def audit_filter_values(logs: DataFrame) -> DataFrame:
    """Sorted distinct values offered by each filter, long form
    ``(filter, value)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("filter"), F.col(c).cast("string").alias("value")) for c in FILTER_COLUMNS])
    out = logs.select(F.explode(pairs).alias("p")).select("p.filter", "p.value").where(F.col("value").isNotNull())
    return out.distinct().orderBy("filter", "value")


def audit_filtered(logs: DataFrame, organization_id: str | None = None,
                   filters: Mapping[str, str] | None = None) -> DataFrame:
    """The log of one organisation, optional ``All``-or-value
    filters on user, action and page, newest first, seven columns."""
    df = logs
    if organization_id is not None:
        df = df.where(F.col("organization_id") == organization_id)
    df = clean.optional_filters(df, dict(filters or {}))
    return df.select(*LOG_COLUMNS).orderBy(F.col("timestamp").desc_nulls_last())


def quality_report(df: DataFrame) -> DataFrame:
    """P19 + A19 + A27 as one tidy table ``(check, column, value)``:
    missing percent per column, format verdicts of text columns, outlier
    counts of numeric columns (only those with outliers).  The audit makes
    several passes (gaps, formats, quartiles, outliers), so the input is
    checkpointed once first."""
    from ..session import cut_lineage
    df = cut_lineage(df)
    missing = profile.missing_report(df).select(
        F.lit("missing_pct").alias("check"), "column", F.col("missing_pct").cast("string").alias("value"))
    fmt = clean.format_audit(df).where(F.col("status") != "ok").select(
        F.concat(F.lit("format:"), F.col("check")).alias("check"), "column",
        F.concat(F.col("status"), F.lit(":"), F.col("bad_rows").cast("string")).alias("value"))
    out = profile.iqr_outliers(df).select(
        F.lit("outliers").alias("check"), "column", F.col("outliers").cast("string").alias("value"))
    return missing.unionByName(fmt).unionByName(out)


def auto_preprocess(df: DataFrame, when=None) -> tuple[DataFrame, DataFrame]:
    """P10 + P12 + P13: fill gaps (median / mode), drop duplicate rows, stamp
    lineage.  Returns the clean table and the action table."""
    filled, actions = clean.auto_fill(df)
    deduped, report = clean.dedupe_with_counts(filled)
    dup_action = report.where(F.col("removed") > 0).select(
        F.lit("*").alias("column"), F.lit("drop_duplicates").alias("method"),
        F.col("removed").cast("string").alias("value"))
    return clean.stamp_lineage(deduped, when=when), actions.unionByName(dup_action)
