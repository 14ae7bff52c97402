"""Hot keys: split them over salts so no single task joins a third of the data.

AQE's skew join only splits a join whose two inputs are fresh shuffles. A
join back to an aggregate (per-text hits, per-key counts, decision flags)
inherits the aggregate's partitioning, so AQE never splits it. Here the hot
keys are found from a count (usually one the job computes anyway), the big
side spreads each hot key's rows over ``salts`` buckets by a hash of the row,
and the small side repeats each hot key's row once per bucket. Cold keys keep
salt 0, so the small side grows only by ``hot keys × salts`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


# A key is hot from this many rows, or from this many bytes of its own text in its rows, on; about one task's worth on
# a large cluster. The table of hot keys holds 64-bit hashes only and is bounded by total rows / HOT_ROWS plus total
# bytes / HOT_BYTES: 10^12 rows of 100 TB give at most 1.8 million hashes, 15 MB. Two keys of one hash are both salted,
# on both sides of the join, so the hash can never change a result.
HOT_ROWS = 1_000_000
HOT_BYTES = 128 << 20
SALTS = 64
HOT_ROWS_CONF = "locflow.skew.hotRows"
SALTS_CONF = "locflow.skew.salts"


def settings(spark) -> tuple[int, int]:
    hot = int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))
    salts = int(spark.conf.get(SALTS_CONF, str(SALTS)))
    return hot, salts


def key_hash(on: list[str]):
    return F.xxhash64(*[F.col(c) for c in on])


def hot_keys(counts: DataFrame, on: list[str], count_col: str, min_rows: int | None = None) -> DataFrame:
    """Hashes (``_key``) of the keys that hold too many rows, or too many bytes, for one task.

    ``counts`` has one row per key (an aggregate the job computes anyway).
    A plain filter: the same rows in any evaluation, so both sides of a
    salted join agree on the hot set.
    """
    if min_rows is None:
        min_rows, _ = settings(counts.sparkSession)
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in on), F.lit(0))
    too_many = (F.col(count_col) > min_rows) | (F.col(count_col) * size > HOT_BYTES)
    return counts.filter(too_many).select(key_hash(on).alias("_key")).distinct()


def heavy_keys(counts: DataFrame, on: list[str], count_col: str, size_col: str) -> DataFrame:
    """``hot_keys`` where ``size_col`` holds the bytes of a key's rows, whatever stands for the key itself."""
    min_rows, _ = settings(counts.sparkSession)
    return counts.filter((F.col(count_col) > min_rows) | (F.col(size_col) > HOT_BYTES)).select(key_hash(on).alias("_key")).distinct()


def hot_rows(rows: DataFrame, on: list[str], min_rows: int | None = None, size_cols: list[str] | None = None) -> DataFrame:
    """``hot_keys`` of rows that nobody has counted yet, counted by the keys' hashes.

    Only 64-bit hashes and counts are shuffled, never the keys; keys of one
    hash count together, so a few more may be salted, none is missed.
    """
    if min_rows is None:
        min_rows, _ = settings(rows.sparkSession)
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in size_cols or on), F.lit(0))
    counts = rows.groupBy(key_hash(on).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.sum(size.cast("bigint")).alias("_size"))
    return counts.filter((F.col("_n") > min_rows) | (F.col("_size") > HOT_BYTES)).select("_key")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                hot: DataFrame | None = None, salt_cols: list[str] | None = None) -> DataFrame:
    """``big.join(small, on, how)`` with hot keys spread over salts.

    ``hot`` are the hot keys (from ``hot_keys``, bounded); if omitted they are
    counted on ``big`` (one partial aggregation). ``salt_cols`` identify a row of
    ``big`` (default: all its columns) and make the salt deterministic, so a
    recomputed partition lands in the same buckets. ``how`` is one of
    ``inner``, ``left``, ``left_semi``, ``left_anti``: every row of ``big``
    meets exactly one copy of its key's ``small`` row.
    """
    spark = big.sparkSession
    min_rows, salts = settings(spark)
    if hot is None:
        hot = hot_rows(big, on, min_rows)
    flag = F.broadcast(hot.withColumn("_hot", F.lit(True)))  # bounded, see HOT_ROWS
    cols = salt_cols or [f.name for f in big.schema.fields if not isinstance(f.dataType, MapType)]
    b = (big.withColumn("_key", key_hash(on)).join(flag, "_key", "left")
            .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in cols]),
                                                              F.lit(salts))).otherwise(F.lit(0)))
            .drop("_hot", "_key"))
    s = (small.withColumn("_key", key_hash(on)).join(flag, "_key", "left")
              .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                             .otherwise(F.array(F.lit(0)))))
              .drop("_hot", "_key"))
    return b.join(s, on + ["_salt"], how).drop("_salt")


def staged_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``salted_join`` of a staged table: where no key is hot, a plain join, behind which rows stay dealt by ``on``.

    Salts would leave them dealt by salts too, and the next aggregation by
    these keys would shuffle them again.
    """
    hot = hot_rows(big, on)
    return big.join(small, on, how) if hot.isEmpty() else salted_join(big, small, on, how, hot=hot)
