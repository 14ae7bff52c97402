"""Source corpora: whole files as rows, and their lines (SRC-05, SRC-06, FLT-07)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locflow.sources import scan


def read_sources(spark: SparkSession, path: str, glob: str = "*.cs",
                 recursive: bool = True, lang: str | None = None) -> DataFrame:
    """``sources(path, lang, content)``: one row per file, content whole.

    Files of a mounted folder are listed and opened by tasks (``scan``), many
    one after the other; of another store Spark splits the listing into tasks
    by size (``spark.sql.files.maxPartitionBytes``). Only files matching
    ``glob`` are read.
    """
    if scan.by_tasks(path):
        files = scan.read_whole(spark, path, glob, recursive)
        return files.select(F.col("uri").alias("path"), F.lit(lang).cast("string").alias("lang"),
                            F.col("content").cast("string").alias("content"))
    df = (spark.read.option("recursiveFileLookup", "true" if recursive else "false")
          .option("pathGlobFilter", glob)
          .text(path, wholetext=True))
    return df.select(F.col("_metadata.file_path").alias("path"),
                     F.lit(lang).cast("string").alias("lang"),
                     F.col("value").alias("content"))


def few_tasks(files: DataFrame, per_core: int = 8) -> DataFrame:
    """A scan of many small files in ``per_core`` tasks a core, each taking many splits one after the other.

    A split holds some tens of small files at most, so a scan has as many
    tasks as the folder has files over that, and a shuffle behind it as many
    blocks for every reader. Order within a file stays.
    """
    return files.coalesce(files.sparkSession.sparkContext.defaultParallelism * per_core)


def below(root: str, path_col: str = "path") -> Column:
    """The part of a file's path below the folder ``root`` (Spark names files by encoded URI); else the whole path."""
    path = F.url_decode(F.replace(F.col(path_col), F.lit("+"), F.lit("%2B")))
    folder = (root if "://" in root else os.path.abspath(root)).rstrip("/").split("://")[-1] + "/"
    at = F.instr(path, folder)
    return F.when(at > 0, path.substr(at + len(folder), F.length(path))).otherwise(path)


def only_extension(df: DataFrame, ext: str = ".cs", path_col: str = "path") -> DataFrame:
    """Keep rows whose path ends with ``ext`` (FLT-07)."""
    return df.filter(F.col(path_col).endswith(ext))


def to_lines(df: DataFrame, text_col: str = "content", keep=("path",),
             line_col: str = "line") -> DataFrame:
    """``lines(<keep>, line_no, <line_col>)``: narrow ``posexplode`` of the split text.

    ``line_no`` is 1-based; a trailing line break yields a last empty line, as
    a line reader would. No shuffle: a file's lines stay in its task.
    """
    parts = F.split(F.col(text_col), "\r?\n", -1)
    return (df.select(*keep, F.posexplode(parts).alias("pos", line_col))
              .select(*keep, (F.col("pos") + 1).cast("bigint").alias("line_no"), line_col))


def write_sources(df: DataFrame, path: str, text_col: str = "rewritten", path_col: str = "path",
                  fmt: str = "parquet") -> None:
    """Write rewritten sources keyed by ``path`` (SNK-02); never in place.

    One row per source file, the working store of a corpus; files under their
    own names are written by ``sources.tree.write_tree``.
    """
    df.select(path_col, F.col(text_col).alias("content")).write.mode("overwrite").format(fmt).save(path)
