"""Load the parquet tables of a data folder.

Reads are lazy; Catalyst prunes columns and pushes filters into the
parquet scan, so callers select what they need and nothing more is read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).orders`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(table_path(self.sf_dir, name))
        return self._cache[name]

    def register_views(self) -> None:
        """Temp views under the table names, for ``spark.sql`` users."""
        for name in TABLES:
            if os.path.exists(table_path(self.sf_dir, name)):
                getattr(self, name).createOrReplaceTempView(name)
