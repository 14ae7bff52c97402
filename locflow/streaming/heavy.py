"""Keys that hold much of a stream, known before a micro-batch is joined (JN-01, JN-03 in streams).

A batch job counts its keys to salt the hot ones. A stream has no global
count; it carries a sketch of frequent items from one micro-batch to the next,
of ``items`` counters whatever the stream's length. A key with at least
``share`` of all rows so far is hot: its rows are spread over salts from the
next micro-batch on. The sketch decides only how rows are dealt, never what
comes out, so a wrong guess costs balance and no row.

Each micro-batch writes its own folder and reads earlier ones, so a replay
writes the same sketch again.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locflow.operators.skew import key_hash
from locflow.streaming.ingest import _read_or_none

ITEMS = 1024
SHARE = 1 / 64
SCHEMA = ("s struct<sketch:binary,maxItemsTracked:int,itemDataType:bigint,itemDataTypeDDL:string>, "
          "n bigint, batch_id bigint")


class HeavyKeys:
    """The sketch of a stream's keys, below ``path``."""

    def __init__(self, path: str, items: int = ITEMS, share: float = SHARE):
        self.path, self.items, self.share = path, items, share

    def _latest(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The sketch as of the last micro-batch before ``batch_id``: one row, or none."""
        kept = _read_or_none(spark, self.path, SCHEMA)
        if kept is None:
            return spark.createDataFrame([], SCHEMA)
        last = kept.where(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
        return kept.where(F.col("batch_id") == F.lit(-1 if last is None else last))

    def hot(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Hashes (``_key``) of the hot keys before ``batch_id``; at most ``1 / share`` of them."""
        # a sketch's estimate is too high by no more than its error, so at most a few keys too many are spread
        items = F.expr(f"approx_top_k_estimate(s, {int(1 / self.share)})")
        rows = self._latest(spark, batch_id).select(F.explode(items).alias("i"), "n")
        return rows.where(F.col("i.count") >= F.col("n") * self.share).select(F.col("i.item").alias("_key"))

    def update(self, keys: DataFrame, on: list[str], batch_id: int) -> None:
        """Add the keys of a micro-batch (columns ``on``) and write the sketch as of ``batch_id``."""
        spark = keys.sparkSession
        new = keys.select(key_hash(on).alias("k")).agg(
            F.expr(f"approx_top_k_accumulate(k, {self.items})").alias("s"), F.count("*").alias("n"))
        both = new.unionByName(self._latest(spark, batch_id).select("s", "n"))
        # two rows: in one partition, as the sketches can't be combined where a partition has none
        both.coalesce(1).agg(F.expr(f"approx_top_k_combine(s, {self.items})").alias("s"), F.sum("n").alias("n")).write.mode("overwrite").parquet(
            os.path.join(self.path, f"batch_id={batch_id}"))
