"""Helpers of the training-data operators: written intermediate tables and worker-side batches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locflow.session import ensure_checkpoint_dir


BATCH_BYTES = 8 << 20       # of one Arrow batch, where the session sets nothing
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package, wherever the driver was started, and bound their batches.

    On a cluster the package is installed or sent along (``--py-files``); the
    entry is then merely one more path. Arrow batches are bounded by bytes as
    well as by rows, so that ten thousand long texts never meet in one.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, by any path that Spark reads."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError(f"set spark.checkpoint.dir to a shared folder before running {name}")
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor re-reads the files; the planner sees their true size, so
    a join broadcasts the table only if it is below the session's threshold.
    """
    spark = df.sparkSession
    importable(spark)
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(classes: DataFrame, number, name: str, col: str = "id") -> DataFrame:
    """Rows with a 64-bit number ``col`` of their own, written: ``number(0)``, and for those few rows that would share
    it ``number(1)`` and so on (``number`` gives a column whose values for two attempts are independent)."""
    for attempt in range(8):
        first = number(0) if not attempt else F.when(F.col("twice"), number(attempt)).otherwise(F.col(col))
        classes = written(classes.withColumn(col, first).drop("twice"), f"{name}-classes")
        twice = written(classes.groupBy(col).count().where("count > 1").select(col, F.lit(True).alias("twice")), f"{name}-twice")
        if twice.isEmpty():
            return classes
        classes = classes.join(twice, col, "left").withColumn("twice", F.coalesce("twice", F.lit(False)))
    raise ValueError("class numbers keep colliding")


def pieces(table, columns, weight_of, limit: int):
    """Cut one Arrow batch into lists of row tuples of at most ``limit`` characters (at least one row)."""
    lists = [table.column(c).to_pylist() for c in columns]
    part, weight = [], 0
    for row in zip(*lists):
        w = weight_of(row)
        if part and weight + w > limit:
            yield part
            part, weight = [], 0
        part.append(row)
        weight += w
    if part:
        yield part
