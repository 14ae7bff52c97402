"""A staged table leaves no shuffle files behind: they stand on disk until its write has ended, not until the driver's next collection."""

import os

from locflow.session import SHUFFLE_CLEANUP, build_session, stage
from pyspark.sql import functions as F


def shuffled(spark):
    """Bytes of the session's shuffle files."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles().toList())
               if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    rows = spark.range(200_000).withColumn("k", F.sha2(F.col("id").cast("string"), 256)).repartition(7, "k")
    staged = stage(rows, "short")
    assert shuffled(spark) <= before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) in (None, "false")
    counts = staged.groupBy("k").count()
    assert counts.count() == 200_000 and counts.count() == 200_000      # later jobs read it as often as they like


def test_a_tree_of_files_leaves_no_shuffle_files(spark, tmp_dir):
    from locflow.sources.tree import write_tree
    before = shuffled(spark)
    rows = spark.range(300).select(F.concat(F.lit("f"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 512).alias("content"))
    assert write_tree(rows.repartition(5, "content"), os.path.join(tmp_dir, "out")) == 300
    # what is left is of the small list of files: names and sizes
    assert shuffled(spark) - before < 300 * 128 / 2
