"""The code view as one file per document: written and named by tasks, read back by few."""

import glob
import os

from locflow.plans.checks import q_source_files
from locflow.session import ensure_checkpoint_dir
from conftest import SF001


def test_many_small_files_are_written_by_tasks_and_read_by_few(spark):
    base = ensure_checkpoint_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(glob.glob(f"{base}/locflow-sources-*"))
    key = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(key)
    spark.conf.set(key, "4m")       # one file a split
    try:
        out = q_source_files(spark, SF001)
        docs = spark.read.parquet(f"{SF001}/documents.parquet")
        assert out.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism < docs.count() == out.count()
    finally:
        spark.conf.set(key, kept)
    [folder] = set(glob.glob(f"{base}/locflow-sources-*")) - before
    names = [n for n in os.listdir(folder) if n.endswith(".txt")]
    assert {int(n.split("-")[1]) for n in names} == {r.doc_id for r in docs.select("doc_id").collect()}
