"""Captured texts (STR-06, STM-01): clean, key, keep what the catalog does not know yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locflow.functions import text as T
from locflow.operators.skew import salted_join


def clean_captures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``cleaned`` (quotes off both ends, colons off the end) and its ``key``; drop blank keys."""
    return (df.withColumn("cleaned", T.clean_capture(text_col))
              .filter(T.has_key("cleaned"))
              .withColumn("key", T.pascal_key("cleaned")))


def new_captures(stream: DataFrame, known: DataFrame, text_col: str = "text",
                 raw_match: bool = False, hot: DataFrame | None = None) -> DataFrame:
    """Captures whose derived key is not known yet (stream–static ``left_anti``).

    Works on a streaming or a batch DataFrame. The known keys are a static
    side re-planned each micro-batch; AQE broadcasts them when measured
    small. ``raw_match=True`` keeps the reference's test of the raw text
    against the keys (Q13) instead of the derived key. ``hot`` are the hashes
    of hot keys, if known (``streaming.heavy``); a batch counts them otherwise,
    a stream then joins without salts.
    """
    c = clean_captures(stream, text_col)
    keys = known.select(F.col("key").alias("_k")).distinct()
    probe = F.col(text_col) if raw_match else F.col("key")
    if hot is not None or not stream.isStreaming:
        c = c.withColumn("_k", probe)
        return salted_join(c, keys, ["_k"], "left_anti", hot=hot).drop("_k")
    return c.join(keys, probe == F.col("_k"), "left_anti")
