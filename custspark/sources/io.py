"""Readers and writers.

Paths are whatever the cluster gives (HDFS, object store, shared mount);
scratch output of the library goes under the shared checkpoint folder,
never a machine-local temp folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

NULL_TOKENS = ("", "NA", "NaN", "nan", "null", "NULL")
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, columns by place.  With a schema no inference pass
    runs (the cluster path); without one, types are inferred (user uploads).  A
    byte-order mark on the first header name is removed.  Missing-value tokens
    are NULL in columns of any type."""
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("nullValue", "")
              .option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT))
    text = reader.csv(path)
    first = text.columns[0] if text.columns else None
    if first and first.startswith("\ufeff"):
        text = text.withColumnRenamed(first, first.lstrip("\ufeff"))
    # tokens go while everything is text, so they neither change a type nor become NaN
    text = text.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in text.columns])
    if schema is not None:
        fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if len(fields) != len(text.columns):
            raise ValueError(f"{len(text.columns)} columns in the file, {len(fields)} in the schema")
        types = [(c, f.name, f.dataType) for c, f in zip(text.columns, fields)]
    else:
        types = [(c, c, t) for c, t in _inferred(text)]
    return text.select(*[_typed(F.col(f"`{c}`"), t).alias(name) for c, name, t in types])


def _typed(col: Column, kind: T.DataType) -> Column:
    """A text column as another type; what cannot be read is NULL."""
    if isinstance(kind, T.TimestampNTZType):
        return F.coalesce(F.try_to_timestamp(col, F.lit(TS_FORMAT)).cast(kind), col.try_cast(kind))
    return col.try_cast(kind)


def _inferred(text: DataFrame) -> list[tuple[str, T.DataType]]:
    """The narrowest of long, double, boolean and timestamp that reads every value of a column, else text; one
    aggregate over the table."""
    kinds = (T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType())
    col = lambda c: F.col(f"`{c}`")
    row = text.agg(F.lit(0), *[F.max(F.when(col(c).isNotNull(), col(c).try_cast(k).isNull())).alias(f"{i}_{j}")
                               for i, c in enumerate(text.columns) for j, k in enumerate(kinds)]).first()
    return [(c, next((k for j, k in enumerate(kinds) if row[f"{i}_{j}"] is False), T.StringType()))
            for i, c in enumerate(text.columns)]


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with microsecond timestamps (the default keeps only ms)."""
    df.write.mode(mode).option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT).json(path)


def read_json(spark: SparkSession, path: str, multiline: bool = False,
              schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, or one array of records with ``multiline``."""
    reader = (spark.read.option("multiLine", multiline).option("timestampFormat", TS_FORMAT)
              .option("timestampNTZFormat", TS_FORMAT))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header (one file per task; no coalesce to one
    file, which would funnel the table through one task)."""
    (df.write.mode(mode).option("header", True).option("timestampFormat", TS_FORMAT)
     .option("timestampNTZFormat", TS_FORMAT).csv(path))


def save_model(model, path: str) -> None:
    """Spark ML persistence (pipelines and fitted models)."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


AUDIT_SCHEMA = ("user_email string, role string, organization_id string, action_type string, "
                "page_name string, file_name string, details string, timestamp timestamp_ntz")


def append_audit(events: DataFrame, path: str) -> None:
    """Append events to the audit table, partitioned by organisation."""
    events.select(*[c.split()[0] for c in AUDIT_SCHEMA.split(", ")]) \
        .write.mode("append").partitionBy("organization_id").parquet(path)


def log_event(spark: SparkSession, path: str, user_email: str, role: str, organization_id: str,
              action_type: str, page_name: str, file_name: str | None = None,
              details: str | None = None) -> None:
    """S6 for one event (the page-level call)."""
    row = spark.createDataFrame([(user_email, role, organization_id, action_type, page_name, file_name, details)],
                                "user_email string, role string, organization_id string, action_type string, "
                                "page_name string, file_name string, details string")
    # naive UTC wall time, as the original stamp (utcnow)
    append_audit(row.withColumn("timestamp", F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())), path)


def read_audit(spark: SparkSession, path: str, organization_id: str | None = None) -> DataFrame:
    """The audit table of one organisation (partition-pruned read).  The
    schema is given so the partition column stays text."""
    df = spark.read.schema(AUDIT_SCHEMA).parquet(path)
    return df.where(F.col("organization_id") == organization_id) if organization_id is not None else df


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """Raise with the list of missing columns (schema only, no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive table fingerprint ``(rows, hash_sum)``: the sum
    of a 64-bit hash of every row, as a decimal so it cannot overflow.
    Equal tables give equal fingerprints on any partitioning, so a re-sent
    upload can be recognised without keeping the old file."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("decimal(38,0)").alias("hash_sum"))


def unique_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
