"""Long columns are shuffled once a step: what only counts or compares moves as hashes."""

from pyspark.sql import functions as F

from locflow.operators import catalog as C
from locflow.operators import memory as M
from locflow.operators.skew import hot_rows, staged_join
from locflow.session import stage


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark, n=300):
    return spark.range(n).select(F.lit("en").alias("lang"), F.concat(F.lit("Text no. "), F.col("id") % 100,
                                 F.when(F.col("id") % 7 == 0, "!").otherwise("")).alias("text"), F.col("id").alias("n"))


def test_keys_are_counted_and_joined_by_digests(spark):
    keys = C.derive_keys(texts(spark), order_cols=("n",))
    for line in plan(keys).splitlines():
        if "Aggregate [" in line:       # no grouping by a key; the text groups once
            assert "transform(" not in line.split("], [")[0]
    rows = {r.text: r for r in keys.collect()}
    assert rows["Text no. 7"].texts_per_key == 2 and rows["Text no. 7"].key == "TextNo7" and rows["Text no. 7"].key_uses == 3
    assert {(r.text, r.winner) for r in C.key_conflicts(keys).where("key = 'TextNo7'").collect()} == {("Text no. 7", "Text no. 7!")}


def test_an_upsert_keeps_a_source_once_and_meets_winners_by_digests(spark):
    batch = C.catalog_rows(texts(spark), order_cols=("n",)).withColumn(
        "source", F.when(F.col("seq.n") == 3, F.lit("other")).when(F.col("seq.n") == 4, F.lit(None)).otherwise(F.col("target")))
    catalog = C.first_wins(C.catalog_rows(texts(spark, 20).withColumn("text", F.upper("text")), order_cols=("n",)))
    inserted, conflicts = C.upsert_catalog(catalog.where("key <> 'TextNo3' and key <> 'TextNo4'"), batch, materialize=True)
    got = {r.key: r for r in inserted.collect()}
    assert got["TextNo3"].source == "other" and got["TextNo4"].source is None and got["TextNo50"].source == "Text no. 50"
    assert {r.against for r in conflicts.collect()} == {"catalog", "batch"}
    assert "_key_id" in plan(conflicts)     # losers meet their winner by the key's digest


def test_hot_rows_shuffle_hashes_only(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("text"))
    hot = hot_rows(rows, ["text"], min_rows=100)
    assert hot.count() == 1
    assert "hashpartitioning(text" not in hot._jdf.queryExecution().executedPlan().toString()
    memory = spark.createDataFrame([("hot", "x")], "src_text string, tgt_text string")
    assert M.lookup_memory(rows, memory).where("translation = 'x'").count() == 900


def test_a_staged_table_without_hot_keys_is_joined_plainly(spark):
    t = stage(texts(spark).select("n", F.col("text").alias("key")), "t")
    small = spark.createDataFrame([("Text no. 1",)], "key string")
    assert "_salt" not in plan(staged_join(t, small, ["key"], "left_anti"))
    spark.conf.set("locflow.skew.hotRows", "1")
    try:
        salted = staged_join(t, small, ["key"], "left_anti")
        assert "_salt" in plan(salted) and salted.count() == t.where("key <> 'Text no. 1'").count()
    finally:
        spark.conf.unset("locflow.skew.hotRows")
