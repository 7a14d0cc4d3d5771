"""Distinct counts kept as sketches (A17, A18, A21 at scale).

A table that grows part by part (a day, an upload, an organisation) keeps one HyperLogLog sketch for each
part and each column or set of columns.  Counts over any parts come from merging their sketches, without
reading the rows again.  A sketch takes a few KB (``2**LG_K`` registers of half a byte); its estimate is off
by about ``0.83 / sqrt(2**LG_K)`` (one standard deviation; 1.3 % at the default of 12), and
next to nothing for small counts.  Merging adds no error: the sketch of two parts is the
sketch of their union.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12


def error_bound(lg_k: int = LG_K, deviations: float = 4.0) -> float:
    """Relative error that an estimate stays within, at a number of standard deviations."""
    return deviations * 0.83 / math.sqrt(2 ** lg_k)


def _value(cols: Sequence[str]) -> Column:
    """What is counted: a column without its nulls, or a tuple of columns, nulls being values (a hash of 128 bits stands for it)."""
    if len(cols) == 1:
        return F.col(cols[0]).cast("string")
    return F.md5(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}))


def column_sketches(df: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """``(*by, subset, rows, sketch)``: for every part and every set of columns its rows and the sketch of its distinct values.
    One pass; each task holds a sketch a part and set, however many values there are."""
    aggs = [F.hll_sketch_agg(_value(s), lg_k).alias(f"s{i}") for i, s in enumerate(sets)]
    parts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *aggs)
    held = F.array(*[F.struct(F.lit("+".join(s)).alias("subset"), F.col(f"s{i}").alias("sketch")) for i, s in enumerate(sets)])
    return parts.select(*by, "rows", F.explode(held).alias("h")).select(*by, "h.subset", "rows", "h.sketch")


def keep(sketches: DataFrame, path: str, part: str) -> None:
    """Add the sketches of new parts to a kept table; a part that comes again is replaced."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, subset, rows, distinct_values, duplicates)`` over all parts: merged on read."""
    merged = sketches.groupBy(*by, "subset").agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))
    return merged.withColumn("duplicates", F.greatest(F.col("rows") - F.col("distinct_values"), F.lit(0)))
