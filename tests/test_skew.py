"""Hot keys: a third of all rows on one text / key / actor; results stay exact and the hot side is split."""

from pyspark.sql import functions as F

from locflow.operators import catalog as C
from locflow.operators import memory as M

SKEW_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def _with_conf(spark, conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return old


def _restore(spark, old):
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _texts(spark, n=30000):
    return (spark.range(n).select(F.col("id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"),
                                  F.when(F.col("id") % 3 == 0, F.lit("Hot text"))
                                   .otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text")))


def test_memory_lookup_hot_text_is_split_and_exact(spark):
    old = _with_conf(spark, {**SKEW_CONF, "locflow.skew.hotRows": "1000", "locflow.skew.salts": "8",
                             "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    try:
        texts = _texts(spark)
        mem = spark.createDataFrame([("und", "en", "Hot text", "hot!"), ("und", "en", "text 1", "one")],
                                    "src_lang string, tgt_lang string, src_text string, tgt_text string")
        translated, untranslated = M.translate_from_memory(texts, mem)
        assert translated.count() == 10001
        assert untranslated.count() == 30000 - 10001
        assert translated.filter("text = 'Hot text' AND translation = 'Hot!'").count() == 10000
        # the hot text's 10,000 rows are spread over several tasks, not one
        parts = (translated.filter("text = 'Hot text'").select(F.spark_partition_id().alias("p"))
                 .distinct().count())
        assert parts > 1
    finally:
        _restore(spark, old)


def test_keys_with_hot_key_exact(spark):
    old = _with_conf(spark, {**SKEW_CONF, "locflow.skew.hotRows": "100", "locflow.skew.salts": "8"})
    try:
        rows = _texts(spark).select(F.lit("en").alias("lang"), "text", F.col("conv_id").alias("n"))
        # many spellings of one key: "hot text", "Hot, text!" ... plus the hot text itself
        variants = spark.range(5000).select(F.lit("en").alias("lang"),
                                            F.concat(F.lit("Hot"), F.expr("repeat(' ', cast(id % 7 + 1 as int))"),
                                                     F.lit("text"), F.expr("repeat('!', cast(id as int) % 50)")).alias("text"),
                                            (F.col("id") + 100000).alias("n"))
        keys = C.derive_keys(rows.unionByName(variants), order_cols=("n",))
        hot = keys.filter("key = 'HotText'")
        assert hot.select("texts_per_key").distinct().collect()[0][0] == hot.count()
        conflicts = C.key_conflicts(keys)
        assert conflicts.filter("key = 'HotText'").count() == hot.count() - 1
        assert conflicts.select("winner").distinct().collect()[0][0] == "Hot text"
    finally:
        _restore(spark, old)


def test_long_hot_key_is_split(spark):
    """Keys have no length limit: 20,000 rows of one 600-character key are spread like those of a short one."""
    from locflow.operators.skew import salted_join
    old = _with_conf(spark, {**SKEW_CONF, "locflow.skew.hotRows": "1000", "locflow.skew.salts": "8",
                             "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    try:
        for width in (100, 600):
            big = spark.range(20_000).select("id", F.lit("k" * width).alias("text"))
            small = spark.createDataFrame([("k" * width, 7)], "text string, v int")
            out = salted_join(big, small, ["text"], "left")
            assert out.filter("v = 7").count() == 20_000
            assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        _restore(spark, old)


def test_heavy_key_is_hot_by_bytes(spark):
    from locflow.operators import skew
    counts = spark.createDataFrame([("x" * 3000, 100_000), ("y", 100_000)], "text string, n long")
    hot = skew.hot_keys(counts, ["text"], "n")
    assert hot.count() == 1     # 300 MB of text in one key, against 100 kB


def test_core_variants_with_hot_core(spark):
    from locflow.operators import extract as X
    old = _with_conf(spark, {**SKEW_CONF, "locflow.skew.hotRows": "5", "locflow.skew.salts": "4"})
    try:
        texts = spark.createDataFrame([(p + "Hello" + s,) for p in ("", "/", "(", "-/") for s in ("", ":", "!", "..")] * 20, "text string")
        rows = X.core_variants(texts).collect()
        assert len(rows) == 16 and {r.spellings for r in rows} == {16} and {r.uses for r in rows} == {20}
    finally:
        _restore(spark, old)


def test_known_and_new_keys_spread_a_hot_key(spark):
    """JN-01: 200,000 rows of one key meet the constants in many partitions."""
    from locflow.operators import catalog as C
    rows = spark.range(200_000).select(F.lit("Hot").alias("key"), "id").unionByName(
        spark.range(100).select(F.concat(F.lit("K"), F.col("id").cast("string")).alias("key"), "id"))
    for key, conf in {"locflow.skew.hotRows": "1000", "locflow.skew.salts": "16", "spark.sql.autoBroadcastJoinThreshold": "-1",
                      "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        spark.conf.set(key, conf)
    try:
        for constants, out, n in ((["K1"], C.new_keys, 200_099), (["Hot", "K1"], C.known_keys, 200_001)):
            got = out(rows, spark.createDataFrame([(c,) for c in constants], "key string"))
            per = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(per) == n and max(per) < 100_000 and len(per) > 4
    finally:
        for key in ("locflow.skew.hotRows", "locflow.skew.salts", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(key)
