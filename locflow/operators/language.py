"""Language of a text by token profiles (LNG-01, STM-04).

Profiles are the ``n`` most frequent tokens per language of a labelled
corpus. Scoring counts a text's tokens that are in each profile; the language
with most hits wins (ties: smaller tag), and a text without any hit is
``und``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"(\p{L}+)"


def tokens(text_col: str = "text"):
    """Lower-cased letter runs of a text (array column)."""
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), 1)


def build_profiles(labelled: DataFrame, n: int = 50, text_col: str = "text",
                   lang_col: str = "lang", buckets: int = 64) -> DataFrame:
    """``profiles(lang, token, n, rank)``: top ``n`` tokens per language.

    Exact top-n in two rounds so a language's vocabulary never sits in one
    task: counts by ``(lang, token)`` (partial aggregation), then the top ``n``
    within each ``(lang, hash bucket)``, then the top ``n`` among those
    ``buckets * n`` candidates per language. Ties go to the smaller token.
    """
    counts = (labelled.select(F.col(lang_col).alias("lang"), F.explode(tokens(text_col)).alias("token"))
                      .groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")))
    order = [F.col("n").desc(), F.col("token")]
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets))
    local = (counts.withColumn("_b", bucket)
                   .withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order)))
                   .filter(F.col("_r") <= n).drop("_b", "_r"))
    return (local.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
                 .filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint")))


def detect_language(texts: DataFrame, profiles: DataFrame, id_cols=("doc_id",),
                    text_col: str = "text", override_col: str | None = None) -> DataFrame:
    """``(<id>, detected, hits)`` per text (LNG-01); ``override_col`` wins when set (STM-04).

    Profiles are a small table (``n`` tokens times the number of languages),
    which the planner broadcasts once it has measured it; only the per
    ``(text, lang)`` hit counts are aggregated. The texts
    themselves are not shuffled: only their ids meet the hit counts, so texts
    without a hit come out as ``und``.
    """
    ids = list(id_cols)
    prof = profiles.select("lang", "token")
    toks = texts.select(*ids, F.explode(tokens(text_col)).alias("token"))
    hits = (toks.join(prof, "token").groupBy(*ids, "lang").agg(F.count(F.lit(1)).alias("hits"))
                .groupBy(*ids).agg(F.min(F.struct((-F.col("hits")).alias("neg"), F.col("lang"))).alias("_b"))
                .select(*ids, F.col("_b.lang").alias("detected"), (-F.col("_b.neg")).alias("hits")))
    keep = ids + ([override_col] if override_col else [])
    out = texts.select(*keep).join(hits, ids, "left")
    out = (out.withColumn("detected", F.coalesce(F.col("detected"), F.lit("und")))
              .withColumn("hits", F.coalesce(F.col("hits"), F.lit(0)).cast("bigint")))
    if override_col:
        out = out.withColumn("detected", F.coalesce(F.col(override_col), F.col("detected")))
    return out
