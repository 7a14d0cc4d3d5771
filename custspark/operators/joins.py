"""Joins (J1-J10).

No broadcast hints on tables whose size grows with the data: the join
strategy is left to Catalyst and AQE, which turn a side into a broadcast
only after measuring its shuffle output against
``spark.sql.adaptive.autoBroadcastJoinThreshold``.  AQE's skew-join split
handles hot keys on the large side of a sort-merge join.
``broadcast_bounded`` is the only hinting helper and checks its bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a dimension whose row count is bounded by
    construction (departments, k cluster rows, lever tables).  The bound is
    verified with a count capped at ``max_rows + 1`` rows; above it the
    table is returned unhinted and the planner chooses."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def inner_join_with_loss(left: DataFrame, right: DataFrame, on: Sequence[str] | str):
    """Inner join plus a one-row report of left rows without a partner
    ``(rows_before, rows_dropped)``; the report is a left-anti count, so no
    second full join is run."""
    on = [on] if isinstance(on, str) else list(on)
    joined = left.join(right, on, "inner")
    dropped = left.join(right.select(*on), on, "left_anti")
    report = left.agg(F.count(F.lit(1)).alias("rows_before")).withColumn(
        "rows_dropped", dropped.agg(F.count(F.lit(1))).scalar())
    return joined, report


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``df[df.k.isin(other.k)]``."""
    return df.join(keys.select(on), on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``keys``."""
    return df.join(keys.select(on), on, "left_anti")


def map_ids(df: DataFrame, mapping: DataFrame, col: str, new_col: str, out: str | None = None,
            require_complete: bool = False) -> DataFrame:
    """Replace ``col`` through a mapping table ``(col, new_col)`` by a
    left join (never a Python dict).  With ``require_complete`` the plan
    raises at run time when a non-null id has no mapping
    (``assert_true`` inside the projection)."""
    out = out or col
    joined = df.join(mapping.select(col, new_col), col, "left")
    if require_complete:
        check = F.assert_true(F.col(col).isNull() | F.col(new_col).isNotNull(),
                              F.lit(f"unmapped values in {col}"))
        joined = joined.withColumn("_check", check).drop("_check")
        joined = joined.where(F.coalesce(check.isNull(), F.lit(True)))
    return joined.drop(col).withColumnRenamed(new_col, out)


def join_summaries(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join of two grouped summaries, absent figures become 0."""
    return left.join(right, on, "left").na.fill(0)


def write_back(rows: DataFrame, scored: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Put predictions made on the valid subset back on every row, by
    key (rows that were not scored get NULL)."""
    return rows.join(scored.select(key, *cols), key, "left")
