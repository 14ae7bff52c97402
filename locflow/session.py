"""Spark session defaults for locflow jobs.

A cluster brings its own configuration; these defaults only fill in what is
unset, so the same code runs under ``spark-submit`` on a cluster and under
``local[*]`` in tests.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every locflow job relies on. AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is small, skew-join for hot texts and
# keys) and coalesces small shuffle partitions.
JOB_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),    # a batch of very long texts stays small
    # Strings in this engine are compared ordinally (UTF8_BINARY); ANSI mode
    # stays as the session has it.
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "locflow",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create or fetch a session; set locflow defaults only where unset."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("LOCFLOW_DRIVER_MEMORY", "8g"))
    for k, v in JOB_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - older API
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Use the session's checkpoint folder; create a private one only when unset.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is left
    alone. Only a local session without one (tests, the bench) gets a fresh
    scratch folder.
    """
    current = checkpoint_dir(spark)
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not master.startswith("local"):
        # never a machine-local folder on a cluster; jobs that need one fail
        # in ``stage`` with a clear message
        return None
    path = tempfile.mkdtemp(prefix="locflow-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package; on a cluster it is installed or sent along (``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession):
    """What is written inside leaves no shuffle files behind.

    Spark keeps them until the driver happens to collect the plan's garbage,
    so the shuffles of all staged tables of a job would stand beside each
    other. A write has a plan of its own, which nothing reads again.
    """
    kept = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if kept is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, kept)


def stage(df, name: str = "stage"):
    """Cut lineage: write ``df`` as Parquet into the session's checkpoint folder and read it back.

    For an intermediate that several branches or sinks read (or a long
    chain), so a lost executor reads files again and not the sources. The
    planner knows the written table's size in bytes, so it broadcasts it only
    below the session's threshold. Never a local checkpoint.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before staging " + name)
    path = f"{base.rstrip('/')}/locflow-{name}-{uuid.uuid4().hex}"
    with short_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)     # a third smaller than snappy on texts
    return spark.read.schema(df.schema).parquet(path)
