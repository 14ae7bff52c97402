"""Driver tables as DataFrames (Parquet, pushdown and pruning by Catalyst)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; a folder of part files or a single ``<name>.parquet``, in the splits that it has."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
