"""Sizes in bytes decide, not row counts: staged tables have known sizes, inputs keep their splits."""

from pyspark.sql import functions as F

from locflow.operators import classify as K
from locflow.session import stage


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_table_is_broadcast_only_below_the_threshold(spark):
    big = spark.range(1000).withColumnRenamed("id", "k").repartition(4)
    small = stage(spark.range(50).withColumn("k", F.col("id")).withColumn("pad", F.sha2(F.col("id").cast("string"), 256)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
        assert "BroadcastHashJoin" in _plan(big.join(small, "k"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100b")
        assert "BroadcastHashJoin" not in _plan(big.join(small, "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stoplist_size_is_known_to_the_planner(spark):
    texts = spark.range(100).select(F.col("id").cast("string").alias("text"))
    assert "BroadcastHashJoin" in _plan(K.classify(texts, K.stoplist(spark, [("own", "it's \\ here")])))


def test_stage_keeps_nested_columns(spark):
    df = spark.createDataFrame([(1, ("a", 2))], "k int, seq struct<s:string,n:long>")
    assert [tuple(r) for r in stage(df).collect()] == [(1, ("a", 2))]
