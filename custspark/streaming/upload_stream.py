"""Uploads that are taken once (S9), and a running audit overview.

*Uploads.*  Every file that lands is known by the digest of its bytes.  Spark's streaming state
remembers the digests seen within ``horizon`` of the newest file's time, so a file that lands again, under
whatever name and also after a restart, is skipped.  Only names and digests pass through the state; the rows of
the files that are let through are read by Spark's own reader, and written under the number of their trigger, which a repeated trigger
overwrites: each upload is in the table once.

*Overview.*  Counts by organisation are streaming state, with a watermark on the event time that
leaves late events out once ``lateness`` has passed.  Each trigger writes the counts it changed under its
number; the overview is the newest row of each organisation, so a repeated trigger changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNTS = ["total_events", "uploads", "downloads", "analyses_run"]


def landed_files(spark: SparkSession, landing: str, pattern: str = "*.csv", max_files_per_trigger: int = 1000) -> DataFrame:
    """``(path, landed, length, digest)`` of the files below ``landing``; their bytes go no further than the digest."""
    return (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", max_files_per_trigger).load(landing)
            .select("path", F.col("modificationTime").alias("landed"), "length", F.sha2("content", 256).alias("digest")))


def new_files(files: DataFrame, horizon: str = "30 days") -> DataFrame:
    """The files whose digest has not been seen within ``horizon``."""
    return files.withWatermark("landed", horizon).dropDuplicatesWithinWatermark(["digest"])


def start_uploads(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: str, pattern: str = "*.csv",
                  options: Mapping[str, str] | None = None, horizon: str = "30 days", available_now: bool = True) -> StreamingQuery:
    """Start the ingest of CSV uploads into the Parquet table ``table`` (with a column ``trigger``)."""

    def take(files: DataFrame, number: int) -> None:
        paths = [r["path"] for r in files.select("path").collect()]  # bounded by the files of a trigger
        if paths:
            rows = files.sparkSession.read.schema(schema).options(**(options or {})).csv(paths)
            rows.write.mode("overwrite").parquet(f"{table}/trigger={number}")

    query = new_files(landed_files(spark, landing, pattern), horizon).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query.trigger(processingTime="1 minute")).start()


def running_counts(events: DataFrame, lateness: str = "1 day", by: str = "organization_id", time: str = "timestamp") -> DataFrame:
    """Counts of audit events by organisation, kept up to date (see :func:`custspark.operators.audit.audit_overview`)."""
    a = F.col("action_type")
    return (events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).groupBy(by)
            .agg(F.count(F.lit(1)).alias("total_events"), F.count_if(a == "upload").alias("uploads"),
                 F.count_if(a == "download").alias("downloads"), F.count_if(a == "run_analysis").alias("analyses_run")))


def start_overview(events: DataFrame, table: str, checkpoint: str, lateness: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Start the running overview: every trigger upserts the organisations whose counts changed."""

    def upsert(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/trigger={number}")

    query = running_counts(events, lateness).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query.trigger(processingTime="1 minute")).start()


def read_overview(spark: SparkSession, table: str, by: str = "organization_id") -> DataFrame:
    """The newest counts of each organisation."""
    rows = spark.read.parquet(table)
    newest = F.max_by(F.struct(*COUNTS), "trigger").alias("c")
    return rows.groupBy(by).agg(newest).select(by, "c.*")


def compact_overview(spark: SparkSession, table: str, target: str, by: str = "organization_id") -> None:
    """The overview as one table, so that a long run's triggers need not be read again."""
    read_overview(spark, table, by).withColumn("trigger", F.lit(-1)).write.mode("overwrite").partitionBy("trigger").parquet(target)
