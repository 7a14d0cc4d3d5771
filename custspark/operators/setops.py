"""Sort, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_nulls_last(df: DataFrame, keys: Sequence[str], ascending: Sequence[bool] | bool = True) -> DataFrame:
    """Pandas ``sort_values`` puts missing values last either way."""
    if isinstance(ascending, bool):
        ascending = [ascending] * len(keys)
    cols = [F.col(k).asc_nulls_last() if a else F.col(k).desc_nulls_last()
            for k, a in zip(keys, ascending)]
    return df.orderBy(*cols)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` first rows of a total order.  ``orderBy().limit()``
    plans as TakeOrderedAndProject: every partition keeps its own top k, so
    only k rows per partition move."""
    return df.orderBy(*order).limit(k)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """``pd.concat`` of frames with the same columns (by name)."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_missing(frames: Sequence[DataFrame]) -> DataFrame:
    """Concat where frames lack some columns; gaps are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` not in ``b``."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
