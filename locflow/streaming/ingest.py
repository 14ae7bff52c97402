"""Streaming catalog ingest (STM-02): first occurrence wins across an endless input.

Each micro-batch runs the batch ``upsert_catalog`` against the catalog as it
stands before that batch. The catalog lives in ``<catalog>/batch_id=<n>``
folders: batch ``n`` reads only ``batch_id < n`` (partition pruning) and
overwrites its own folder, so a batch replayed after a failure writes the
same rows again and the result is exactly-once without a table format.

A batch's folder is parted by a hash of the key (``bucket=<b>``, ``BUCKETS``
of them). A micro-batch asks which buckets its own keys have, and reads only
the files of these: what a later batch reads grows with its keys' buckets, not
with all that was ever written.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from locflow.operators.catalog import CATALOG_COLUMNS, catalog_rows, upsert_catalog

CATALOG_SCHEMA = ("lang string, key string, source string, target string, translate boolean, "
                  "origin string, seq struct<ts:timestamp,event_id:bigint>")
BUCKETS = 256


def _bucket():
    return F.pmod(F.xxhash64("lang", "key"), F.lit(BUCKETS)).cast("int")


def _read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``; None only where the path does not exist yet. Any other fault is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _existing(spark: SparkSession, path: str, batch_id: int, schema: str,
              base_path: str | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Catalog rows of earlier batches; empty before the first batch (any Hadoop file system).

    With ``base_path`` (a ``compact_catalog`` snapshot) the snapshot stands in
    for the folders it covers, and only later folders are listed and read.
    With ``buckets`` only these are read: whole folders of the batches, row
    groups of the snapshot. Folders without buckets are read whole.
    """
    wanted = F.lit(True) if buckets is None else F.col("bucket").isNull() | F.col("bucket").isin(*buckets)
    upto = -1
    base = None
    if base_path:
        base = _read_or_none(spark, base_path, schema + ", upto bigint, bucket int")
        if base is not None:
            upto = base.agg(F.max("upto")).first()[0]  # one scalar
            upto = -1 if upto is None else int(upto)
            base = base.filter(wanted).drop("upto", "bucket")
    df = _read_or_none(spark, path, schema + ", batch_id bigint, bucket int")
    if df is None:
        df = spark.createDataFrame([], schema)
    else:
        df = df.filter((F.col("batch_id") < batch_id) & (F.col("batch_id") > upto) & wanted).drop("batch_id", "bucket")
    return df if base is None else base.unionByName(df)


def ingest_batch(batch: DataFrame, batch_id: int, catalog_path: str, conflicts_path: str,
                 text_col: str = "text", lang_col: str = "lang", order_cols=("ts", "event_id"),
                 schema: str = CATALOG_SCHEMA, base_path: str | None = None) -> None:
    """One micro-batch: shape rows, upsert against earlier batches, write this batch's folder."""
    spark = batch.sparkSession
    # kept for the time of the batch: its buckets, its keys and its rows are asked for one after the other
    rows = catalog_rows(batch, text_col, lang_col, order_cols=order_cols, origin="stream").persist()
    try:
        buckets = [r[0] for r in rows.select(_bucket().alias("b")).distinct().collect()]    # at most BUCKETS numbers
        existing = _existing(spark, catalog_path, batch_id, schema, base_path, buckets)
        # Only catalog rows whose key occurs in this micro-batch matter. The semi
        # join lets AQE broadcast the batch's keys (a micro-batch is small next to
        # the catalog), so the catalog is scanned and filtered, not shuffled.
        batch_keys = rows.select("lang", "key").distinct()
        existing = existing.join(batch_keys, ["lang", "key"], "left_semi")
        inserted, conflicts = upsert_catalog(existing, rows)
        (inserted.select(*CATALOG_COLUMNS).withColumn("bucket", _bucket()).repartition("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(catalog_path, f"batch_id={batch_id}")))
        conflicts.write.mode("overwrite").parquet(os.path.join(conflicts_path, f"batch_id={batch_id}"))
    finally:
        rows.unpersist()


def run_ingest(stream: DataFrame, catalog_path: str, conflicts_path: str, checkpoint: str,
               text_col: str = "text", lang_col: str = "lang", order_cols=("ts", "event_id"),
               watermark: tuple[str, str] | None = None, available_now: bool = True,
               base_path: str | None = None, prepare=None):
    """Start the ingest query; returns the ``StreamingQuery``.

    ``watermark=(ts_col, delay)`` thins repeated captures first with
    ``dropDuplicatesWithinWatermark`` on ``(lang, text)``; it drops captures
    older than the watermark, so it is off by default (see
    ``numRowsDroppedByWatermark`` in the query progress when on). ``prepare`` is
    applied to every micro-batch and its id first.
    """
    s = stream
    if watermark:
        s = s.withWatermark(*watermark).dropDuplicatesWithinWatermark([lang_col, text_col])

    def handle(batch_df: DataFrame, batch_id: int) -> None:
        if prepare is not None:
            batch_df = prepare(batch_df, batch_id)
        ingest_batch(batch_df, batch_id, catalog_path, conflicts_path, text_col, lang_col, order_cols,
                     base_path=base_path)

    w = s.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_catalog(spark: SparkSession, catalog_path: str, schema: str = CATALOG_SCHEMA,
                 base_path: str | None = None) -> DataFrame:
    """The catalog as ingested so far: all batch folders, or a snapshot plus the folders after it."""
    if base_path:
        return _existing(spark, catalog_path, 1 << 62, schema, base_path)
    return spark.read.schema(schema + ", batch_id bigint, bucket int").parquet(catalog_path).drop("bucket")


def compact_catalog(spark: SparkSession, catalog_path: str, base_path: str, upto: int,
                    schema: str = CATALOG_SCHEMA, old_base: str | None = None) -> None:
    """Snapshot the catalog (``old_base`` plus folders ``batch_id <= upto``) into ``base_path``.

    A stream started with ``base_path`` then reads the snapshot and only the
    folders after ``upto``, so its per-batch listing stays short. Write each
    snapshot to a new path and switch the stream to it; nothing is deleted.
    Rows lie in order of their buckets, so a batch reads the row groups of its own.
    """
    rows = _existing(spark, catalog_path, upto + 1, schema, old_base)
    (rows.withColumn("upto", F.lit(upto).cast("bigint")).withColumn("bucket", _bucket())
         .repartitionByRange("bucket", "lang", "key").sortWithinPartitions("bucket")
         .write.mode("overwrite").parquet(base_path))


def run_captures(stream: DataFrame, known, catalog_path: str, conflicts_path: str,
                 checkpoint: str, lang: str = "en", text_col: str = "text",
                 order_cols=("ts", "event_id"), available_now: bool = True, heavy: str | None = None):
    """STM-01 + STM-02: clean captured texts, skip keys already known, insert the rest first-wins.

    ``known`` gives the declared keys: a function of the session, called for
    every micro-batch (so keys that were added to its files since count), or
    a DataFrame, which keeps the file listing it was made with. ``heavy`` is a
    folder for a sketch of the stream's frequent keys (``streaming.heavy``):
    hot keys are then known from earlier micro-batches instead of being
    counted in each.
    """
    from locflow.streaming.captures import clean_captures, new_captures
    from locflow.streaming.heavy import HeavyKeys

    sketch = HeavyKeys(heavy) if heavy else None

    def fresh(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        keys = known(spark) if callable(known) else known
        hot = None
        if sketch:
            hot = sketch.hot(spark, batch_id)
            sketch.update(clean_captures(batch, text_col).withColumnRenamed("key", "_k"), ["_k"], batch_id)
        return new_captures(batch, keys, text_col, hot=hot).select(
            *order_cols, F.lit(lang).alias("lang"), F.col("cleaned").alias("text"))

    return run_ingest(stream, catalog_path, conflicts_path, checkpoint, "text", "lang", order_cols,
                      available_now=available_now, prepare=fresh)
