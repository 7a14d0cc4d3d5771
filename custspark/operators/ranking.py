"""Exact row numbering without a single-partition sort.

``row_number() over (order by k)`` with no ``partition by`` moves the whole
table into one task, and ``partition by stratum`` does the same for a
stratum that holds most rows.  Here the table is range-partitioned on
(stratum, order), each partition numbers its rows locally
(``monotonically_increasing_id`` carries the partition index in its upper
bits), a small table of per-(partition, stratum) counts gives every
partition its offset, and a join adds it back.  The tagged table is
checkpointed to the shared checkpoint folder first, so the count pass and
the join see the same partitioning even if executors are lost and the
range bounds would be re-sampled.

The order must be total (callers append the row key as a tie-breaker);
then the result equals ``row_number() over (partition by strata order by
...)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id: partition index << 33 | row


def shuffle_width(spark) -> int:
    """The session's shuffle width, else the default parallelism (a width may be set to "auto")."""
    conf = spark.conf.get("spark.sql.shuffle.partitions", None)
    try:
        return max(int(conf), 1)
    except (TypeError, ValueError):
        return max(spark.sparkContext.defaultParallelism, 1)


def _as_cols(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def row_number_distributed(df: DataFrame, order: Sequence[Column | str],
                           strata: Sequence[str] = (), out: str = "row_number",
                           num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based row number in ``order`` within each stratum."""
    spark = df.sparkSession
    n = num_partitions or shuffle_width(spark)
    strata = list(strata)
    order_cols = _as_cols(order)
    keys = [F.col(s) for s in strata] + order_cols
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged)
    tagged = (tagged.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
              .withColumn("_loc", F.col("_mid") - F.shiftleft(F.col("_pid"), _LOCAL_BITS)))
    counts = (tagged.groupBy("_pid", *strata)
              .agg(F.count(F.lit(1)).alias("_cnt"), F.min("_loc").alias("_start")))
    # counts has at most (#partitions + #strata) rows
    w = (Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))).orderBy("_pid")
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = offsets.select(*[F.col(s).alias(f"_s_{i}") for i, s in enumerate(strata)],
                             F.col("_pid").alias("_opid"), "_off", "_start")
    cond = reduce(lambda a, b: a & b,
                  [F.col(s).eqNullSafe(F.col(f"_s_{i}")) for i, s in enumerate(strata)],
                  F.col("_pid") == F.col("_opid"))
    res = tagged.join(offsets, cond)
    return (res.withColumn(out, F.col("_off") + F.col("_loc") - F.col("_start") + F.lit(1))
            .drop("_mid", "_pid", "_loc", "_opid", "_off", "_start",
                  *[f"_s_{i}" for i in range(len(strata))]))


def dense_ids(df: DataFrame, id_col: str, out: str = "new_id") -> DataFrame:
    """Mapping ``(id_col, out)`` numbering the *distinct* ids 1..n in
    ascending order.  Built from the distinct ids only, then joined (J7)."""
    distinct = df.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return row_number_distributed(distinct, [id_col], out=out)


def sequential_ids(df: DataFrame, order: Sequence[Column | str], out: str = "seq_id") -> DataFrame:
    """1..n over the rows in a stated order (Spark has no row order)."""
    return row_number_distributed(df, order, out=out)
