"""Selections by id order and by hash order.

The original draws use a seeded random sample; Spark has no row order, so
the draw is replaced by the order of ``md5(cast(id as string))`` - stable
under any partitioning and reproducible in SQL.  Exact per-stratum
quotas use the distributed row numbering of :mod:`.ranking`, so a stratum
holding most rows is still numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import row_number_distributed


def hash_order(id_col: str) -> Column:
    return F.md5(F.col(id_col).cast("string"))


def first_n_ids(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Rows of the first ``n`` distinct ids in ascending order.  The
    limit is the feature (a capped customer list); ``n`` is small, so the
    top-n runs as a per-partition take-ordered and a semi-join."""
    ids = df.select(id_col).distinct().orderBy(id_col).limit(n)
    return df.join(ids, id_col, "left_semi")


def majority_downsample(df: DataFrame, id_col: str, label: str, cap: int,
                        majority: int = 0) -> DataFrame:
    """Cap the table at ``cap`` rows by dropping majority-class rows only,
    the first ``excess`` of them in hash order.  When the majority class is
    smaller than the excess nothing is dropped."""
    counts = df.agg(F.struct(F.count(F.lit(1)).alias("total"),
                             F.count_if(F.col(label) == majority).alias("n_major")).alias("c")).scalar()
    excess = counts["total"] - F.lit(cap)
    drop_n = F.when((excess > 0) & (counts["n_major"] >= excess), excess).otherwise(F.lit(0))
    major = df.where(F.col(label) == majority).select(id_col)
    ranked = row_number_distributed(major, [hash_order(id_col), F.col(id_col)], out="_rn")
    dropped = ranked.where(F.col("_rn") <= drop_n).select(id_col)
    return df.join(dropped, id_col, "left_anti")


def quota_sample(counts_df: DataFrame, id_col: str, count_col: str, total: int = 5000,
                 min_single: int = 1000) -> DataFrame:
    """Choose ``total`` ids: all with >= 3 events, then ids with 2 and
    with 1 event by quota (slightly more 2s than 1s), each stratum in hash
    order.  ``counts_df`` has one row per id with its event count.  Quotas
    are clamped at zero where the original would raise."""
    stratum = F.when(F.col(count_col) >= 3, F.lit(3)).otherwise(F.col(count_col))
    df = counts_df.select(id_col, stratum.alias("_stratum"))
    c = df.agg(F.struct(*[F.count_if(F.col("_stratum") == k).alias(f"n{k}") for k in (1, 2, 3)])
               .alias("c")).scalar()
    need = F.lit(total) - c["n3"]
    q1 = F.least(c["n1"], F.lit(min_single))
    q2 = F.least(c["n2"], need - q1)
    extra = F.least(c["n2"] - q2, q1 - q2 + F.lit(100))
    q2_final = F.when(q2 < q1, q2 + extra).otherwise(q2)
    q1_final = F.when(q2 < q1, need - q2_final).otherwise(q1)
    q1_final = F.greatest(q1_final, F.lit(0))
    q2_final = F.greatest(q2_final, F.lit(0))
    ranked = row_number_distributed(df.where(F.col("_stratum") < 3),
                                    [hash_order(id_col), F.col(id_col)], strata=["_stratum"], out="_rn")
    chosen = ranked.where(((F.col("_stratum") == 1) & (F.col("_rn") <= q1_final))
                          | ((F.col("_stratum") == 2) & (F.col("_rn") <= q2_final)))
    return (df.where(F.col("_stratum") == 3).select(id_col, F.col("_stratum").alias("stratum"))
            .unionByName(chosen.select(id_col, F.col("_stratum").alias("stratum"))))


def stratified_split(df: DataFrame, id_col: str, label: str, test_fraction: float = 0.2,
                     out: str = "split") -> DataFrame:
    """Per class, the first ``round(test_fraction * n_class)`` rows in
    hash order are ``test``, the rest ``train``.  The label must not be
    null (it keys the class-size map)."""
    ranked = row_number_distributed(df, [hash_order(id_col), F.col(id_col)], strata=[label], out="_rn")
    # class sizes as a {label: n} map in a scalar subquery (one entry per class)
    sizes = (df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
             .agg(F.map_from_entries(F.collect_list(F.struct(label, "_n")))).scalar())
    n_test = F.floor(sizes[F.col(label)] * F.lit(test_fraction) + F.lit(0.5))
    return (ranked.withColumn(out, F.when(F.col("_rn") <= n_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("_rn"))


def hash_split(df: DataFrame, id_col: str, test_fraction: float = 0.2, out: str = "split") -> DataFrame:
    """W7 at scale, approximate: a fixed hash bucket decides, no shuffle."""
    bucket = F.pmod(F.xxhash64(F.col(id_col)), F.lit(10000))
    return df.withColumn(out, F.when(bucket < int(test_fraction * 10000), F.lit("test"))
                         .otherwise(F.lit("train")))


def split_side_tables(split: DataFrame, side: DataFrame, id_col: str, part: str = "train",
                      split_col: str = "split") -> DataFrame:
    """Rows of a side table that belong to the customers of one part."""
    keys = split.where(F.col(split_col) == part).select(id_col)
    return side.join(keys, id_col, "left_semi")
