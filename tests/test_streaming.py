import os
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from locflow.operators.catalog import catalog_rows, upsert_catalog
from locflow.operators.review import actions_from_events, review_outcomes
from locflow.streaming.captures import new_captures
from locflow.streaming.ingest import read_catalog, run_ingest
from locflow.streaming.review import review_stream

EVENTS_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _split_events(spark, folder, parts=4):
    """Write sf0.01 events as ``parts`` time-ordered files with increasing mtimes."""
    ev = spark.read.parquet(f"{SF01}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    b = ev.withColumn("_p", F.ntile(parts).over(Window.orderBy("ts", "event_id")))
    src = os.path.join(folder, "src")
    os.makedirs(src)
    now = time.time() - 1000
    for i in range(1, parts + 1):
        out = os.path.join(folder, f"stage{i}")
        b.filter(F.col("_p") == i).drop("_p").coalesce(1).write.parquet(out)
        f = [n for n in os.listdir(out) if n.endswith(".parquet")][0]
        dst = os.path.join(src, f"part{i}.parquet")
        os.link(os.path.join(out, f), dst)
        os.utime(dst, (now + i * 10, now + i * 10))
    return src, ev


def test_review_stream_equals_batch(spark, tmp_dir):
    src, ev = _split_events(spark, tmp_dir)
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(tmp_dir, "review_out")
    q = (review_stream(actions_from_events(stream)).writeStream.format("parquet")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck_review")).outputMode("append")
         .trigger(availableNow=True).start(out))
    q.awaitTermination(300)
    got = spark.read.parquet(out).select("event_id", "outcome")
    want = review_outcomes(actions_from_events(ev)).select("event_id", "outcome")
    assert got.count() == want.count() == 5977
    assert got.exceptAll(want).count() == 0
    counts = {r.outcome: r["count"] for r in got.groupBy("outcome").count().collect()}
    assert counts == {"opened": 1336, "rejected_busy": 646, "accepted": 637, "declined": 641, "ignored": 2717}


def test_ingest_stream_equals_batch_and_restart_is_idempotent(spark, tmp_dir):
    src, ev = _split_events(spark, tmp_dir)
    def shape(df):
        return df.select("ts", "event_id", F.lit("en").alias("lang"),
                         F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("text"))
    stream = shape(spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    cat, conf, ck = (os.path.join(tmp_dir, n) for n in ("catalog", "conflicts", "ck"))
    run_ingest(stream, cat, conf, ck).awaitTermination(300)
    got = read_catalog(spark, cat)
    empty = spark.createDataFrame([], "lang string, key string, source string, target string, translate boolean, origin string, seq struct<ts:timestamp,event_id:bigint>")
    want, _ = upsert_catalog(empty, catalog_rows(shape(ev), order_cols=("ts", "event_id")))
    cols = ["lang", "key", "target"]
    assert got.count() == want.count() == 750
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    # first occurrence wins: each key's row is the earliest capture
    assert got.select(*cols, "seq").exceptAll(want.select(*cols, "seq")).count() == 0
    # restart from the checkpoint: nothing new
    run_ingest(stream, cat, conf, ck).awaitTermination(300)
    assert read_catalog(spark, cat).count() == 750


def test_new_captures_stream(spark, tmp_dir):
    src, _ = _split_events(spark, tmp_dir, parts=2)
    stream = (spark.readStream.schema(EVENTS_SCHEMA).parquet(src)
              .select(F.concat(F.lit('"'), F.col("event_type"), F.lit(':"')).alias("text")))
    known = spark.createDataFrame([("View",), ("Click",)], "key string")
    out = os.path.join(tmp_dir, "caps")
    q = (new_captures(stream, known).writeStream.format("parquet").option("checkpointLocation", out + "_ck")
         .trigger(availableNow=True).start(out))
    q.awaitTermination(300)
    keys = {r.key for r in spark.read.parquet(out).select("key").distinct().collect()}
    assert keys == {"Signup", "Purchase", "Error"}


def test_ingest_with_watermark_dedup(spark, tmp_dir):
    src, ev = _split_events(spark, tmp_dir)
    def shape(df):
        return df.select("ts", "event_id", F.lit("en").alias("lang"),
                         F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("text"))
    stream = shape(spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    cat, conf, ck = (os.path.join(tmp_dir, n) for n in ("catalog", "conflicts", "ck"))
    q = run_ingest(stream, cat, conf, ck, watermark=("ts", "1 day"))
    q.awaitTermination(300)
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p.get("stateOperators", []))
    assert dropped == 0  # input is in time order, nothing is late
    got = read_catalog(spark, cat).select("lang", "key", "target")
    empty = spark.createDataFrame([], "lang string, key string, source string, target string, translate boolean, origin string, seq struct<ts:timestamp,event_id:bigint>")
    want, _ = upsert_catalog(empty, catalog_rows(shape(ev), order_cols=("ts", "event_id")))
    assert got.count() == 750 and got.exceptAll(want.select("lang", "key", "target")).count() == 0


def test_review_stream_out_of_order_with_watermark(spark, tmp_dir):
    """Files arrive out of time order (3rd quarter before the 2nd); buffering under a watermark restores order."""
    ev = spark.read.parquet(f"{SF01}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    b = ev.withColumn("_p", F.ntile(4).over(Window.orderBy("ts", "event_id")))
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    now = time.time() - 1000
    order = [1, 3, 2, 4]
    for k, part in enumerate(order):
        out = os.path.join(tmp_dir, f"stage{part}")
        b.filter(F.col("_p") == part).drop("_p").coalesce(1).write.parquet(out)
        f = [n for n in os.listdir(out) if n.endswith(".parquet")][0]
        dst = os.path.join(src, f"part{k}.parquet")
        os.link(os.path.join(out, f), dst)
        os.utime(dst, (now + k * 10, now + k * 10))
    # a far-future event from another actor moves the watermark past everything
    sentinel = os.path.join(tmp_dir, "sentinel")
    spark.createDataFrame([(10**9, "2030-01-01 00:00:00", -1, "view", 0.0, "{}")],
                          "event_id long, ts string, user_id long, event_type string, value double, props string") \
         .withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(sentinel)
    f = [n for n in os.listdir(sentinel) if n.endswith(".parquet")][0]
    dst = os.path.join(src, "part9.parquet")
    os.link(os.path.join(sentinel, f), dst)
    os.utime(dst, (now + 100, now + 100))
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(tmp_dir, "review_out")
    q = (review_stream(actions_from_events(stream), delay="30 days").writeStream.format("parquet")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck_review")).outputMode("append")
         .trigger(availableNow=True).start(out))
    q.awaitTermination(300)
    got = spark.read.parquet(out).filter("actor <> -1").select("event_id", "outcome")
    want = review_outcomes(actions_from_events(ev)).select("event_id", "outcome")
    assert got.count() == want.count() == 5977
    assert got.exceptAll(want).count() == 0


def test_capture_stream_skips_known_and_ingests(spark, tmp_dir):
    from locflow.streaming.ingest import run_captures
    src, ev = _split_events(spark, tmp_dir, parts=2)
    stream = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
              .select("ts", "event_id", F.concat(F.lit('"'), F.col("event_type"), F.lit(' '),
                                                F.col("user_id").cast("string"), F.lit(':"')).alias("text")))
    known = spark.createDataFrame([("View7",), ("Click46",)], "key string")
    cat, conf, ck = (os.path.join(tmp_dir, n) for n in ("catalog", "conflicts", "ck"))
    run_captures(stream, known, cat, conf, ck).awaitTermination(300)
    got = read_catalog(spark, cat)
    keys = {r.key for r in got.select("key").collect()}
    assert "View7" not in keys and "Click46" not in keys and "Error8" in keys
    assert got.count() == 750 - 2
    assert got.filter("target LIKE '%:%' OR target LIKE '%\"%'").count() == 0  # cleaned (STR-06)


def test_captures_read_known_keys_per_batch(spark, tmp_dir):
    """Known keys come from files that grow between batches; a key added after the start is known from then on."""
    from locflow.streaming.ingest import run_captures
    src, _ = _split_events(spark, tmp_dir, parts=2)
    stream = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
              .select("ts", "event_id", F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("text")))
    keys = os.path.join(tmp_dir, "keys")
    spark.createDataFrame([("Nothing",)], "key string").write.parquet(keys)
    calls = []

    def known(session):
        calls.append(1)
        if len(calls) == 2:     # between the batches someone declares all views
            ev = session.read.schema(EVENTS_SCHEMA).parquet(src).filter("event_type = 'view'")
            ev.select(F.concat(F.lit("View"), F.col("event_id").cast("string")).alias("key")).write.mode("append").parquet(keys)
        return session.read.parquet(keys)

    cat, conf, ck = (os.path.join(tmp_dir, n) for n in ("catalog", "conflicts", "ck"))
    run_captures(stream, known, cat, conf, ck).awaitTermination(300)
    per = {r["batch_id"]: r["count"] for r in spark.read.parquet(cat).filter("key LIKE 'View%'").groupBy("batch_id").count().collect()}
    assert len(calls) == 2 and per.get(0, 0) > 0 and per.get(1, 0) == 0


def test_only_a_missing_path_reads_as_empty(spark, tmp_dir):
    import pytest
    from pyspark.errors import AnalysisException
    from locflow.streaming.ingest import CATALOG_SCHEMA, _existing
    assert _existing(spark, os.path.join(tmp_dir, "not there"), 3, CATALOG_SCHEMA).count() == 0
    there = os.path.join(tmp_dir, "there")
    spark.range(3).write.parquet(os.path.join(there, "batch_id=0"))
    with pytest.raises(AnalysisException):      # any other fault is raised, not taken for an empty catalog
        _existing(spark, there, 3, "lang string, lang string").count()


def test_compaction_is_spread_by_key(spark, tmp_dir):
    from locflow.streaming.ingest import CATALOG_SCHEMA, compact_catalog
    cat, base = os.path.join(tmp_dir, "catalog"), os.path.join(tmp_dir, "base")
    rows = spark.range(4000).selectExpr(
        "'en' AS lang", "concat('K', id) AS key", "'s' AS source", "repeat('t', 200) AS target", "true AS translate", "'o' AS origin",
        "struct(timestamp'2024-01-01' AS ts, id AS event_id) AS seq")
    rows.write.parquet(os.path.join(cat, "batch_id=0"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compact_catalog(spark, cat, base, upto=0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sum(p.startswith("part-") for p in os.listdir(base)) > 1
    assert spark.read.schema(CATALOG_SCHEMA).parquet(base).count() == 4000


def test_ingest_with_compacted_snapshot(spark, tmp_dir):
    """Same stream, same checkpoint: two files, a snapshot of those batches, two more files read against it."""
    from locflow.streaming.ingest import compact_catalog
    full, ev = _split_events(spark, tmp_dir)
    src = os.path.join(tmp_dir, "live")
    os.makedirs(src)
    files = sorted(os.listdir(full))
    def shape(df):
        return df.select("ts", "event_id", F.lit("en").alias("lang"),
                         F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("text"))
    def stream():
        return shape(spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    cat, conf, ck, base = (os.path.join(tmp_dir, n) for n in ("catalog", "conflicts", "ck", "base"))
    for f in files[:2]:
        os.link(os.path.join(full, f), os.path.join(src, f))
    run_ingest(stream(), cat, conf, ck).awaitTermination(300)
    upto = max(int(n.split("=")[1]) for n in os.listdir(cat) if n.startswith("batch_id="))
    compact_catalog(spark, cat, base, upto=upto)
    for f in files[2:]:
        os.link(os.path.join(full, f), os.path.join(src, f))
    run_ingest(stream(), cat, conf, ck, base_path=base).awaitTermination(300)
    got = read_catalog(spark, cat, base_path=base).select("lang", "key", "target")
    empty = spark.createDataFrame([], "lang string, key string, source string, target string, translate boolean, origin string, seq struct<ts:timestamp,event_id:bigint>")
    want, _ = upsert_catalog(empty, catalog_rows(shape(ev), order_cols=("ts", "event_id")))
    assert got.count() == 750 and got.exceptAll(want.select("lang", "key", "target")).count() == 0


def test_batches_read_only_the_buckets_of_their_keys(spark, tmp_dir):
    from locflow.streaming import ingest
    cat, conf = os.path.join(tmp_dir, "catalog"), os.path.join(tmp_dir, "conflicts")
    batch = lambda texts: spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text string, event_id long").select(
        F.lit(None).cast("timestamp").alias("ts"), "event_id", F.lit("en").alias("lang"), "text")
    ingest.ingest_batch(batch([f"Text {k}" for k in range(2000)]), 0, cat, conf)
    ingest.ingest_batch(batch(["Text 7", "text  7!", "Brand new"]), 1, cat, conf)
    assert sorted(r.key for r in read_catalog(spark, cat).where("batch_id = 1").collect()) == ["BrandNew"]
    assert [(r.kept, r.dropped, r.against) for r in spark.read.parquet(conf).where("batch_id = 1").collect()] == [("Text 7", "text  7!", "batch")]
    rows = catalog_rows(batch(["Text 7"]), order_cols=("ts", "event_id"))
    bucket = rows.select(ingest._bucket().alias("b")).first().b
    one = ingest._existing(spark, cat, 2, ingest.CATALOG_SCHEMA, buckets=[bucket])
    files = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"bucket={bucket}/" in f for f in files)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert one.where("key = 'Text7'").count() == 1
    # a snapshot is read by bucket too, and a replay of a batch changes nothing
    base = os.path.join(tmp_dir, "base")
    ingest.compact_catalog(spark, cat, base, upto=0)
    ingest.ingest_batch(batch(["Text 7", "text  7!", "Brand new"]), 1, cat, conf, base_path=base)
    assert read_catalog(spark, cat, base_path=base).count() == 2001


def test_review_of_a_busy_actor_is_spread_and_equals_the_batch(spark, tmp_dir):
    from locflow.streaming.review import run_review
    src, ev = _split_events(spark, tmp_dir)
    busy = lambda df: actions_from_events(df).withColumn("actor", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("actor")))
    stream = busy(spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    out, last, ck = (os.path.join(tmp_dir, n) for n in ("out", "last", "ck"))
    skip = F.col("event_id") % 10 == 0
    run_review(stream, out, last, ck, skip_review=skip).awaitTermination(300)
    cols = ["actor", "event_id", "action", "outcome"]
    got, want = spark.read.parquet(out), review_outcomes(busy(ev), skip_review=skip)
    assert got.select("batch_id").distinct().count() == 4
    assert got.count() == want.count() == 5977 and got.select(cols).exceptAll(want.select(cols)).count() == 0
    run_review(stream, out, last, ck, skip_review=skip).awaitTermination(300)       # nothing new, nothing twice
    assert spark.read.parquet(out).count() == 5977
    # the busy actor's third of a batch lies in many partitions before it is written
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mine = review_outcomes(busy(ev), carried=spark.createDataFrame([(-1, "propose")], "actor long, action string")).where("actor = -1")
        parts = [r[1] for r in mine.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 4 and max(parts) < sum(parts) / 2
    first = mine.orderBy("ts", "event_id").first()
    assert first.outcome == {"propose": "rejected_busy", "accept": "accepted", "decline": "declined"}[first.action]


def test_hot_keys_of_a_stream_are_spread_from_the_second_batch_on(spark, tmp_dir):
    from locflow.streaming.heavy import HeavyKeys
    from locflow.streaming.ingest import run_captures
    heavy = HeavyKeys(os.path.join(tmp_dir, "heavy"), items=64)
    keys = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("K"), F.col("id").cast("string"))).alias("_k"))
    assert heavy.hot(spark, 0).count() == 0
    heavy.update(keys, ["_k"], 0)
    heavy.update(keys.where("_k <> 'Hot'").limit(100), ["_k"], 1)
    hot = [r._key for r in heavy.hot(spark, 2).collect()]
    assert hot == [spark.range(1).select(F.xxhash64(F.lit("Hot"))).first()[0]]
    assert [r._key for r in heavy.hot(spark, 1).collect()] == hot and heavy.hot(spark, 0).count() == 0     # a replay sees what the batch saw
    heavy.update(keys, ["_k"], 1)
    # the same join, on a stream: rows of the hot key lie in many partitions, and none is lost
    src = os.path.join(tmp_dir, "texts")
    keys.select("id", F.col("_k").alias("text")).repartition(2).write.parquet(src)
    seen = []
    for conf, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(conf, value)
    try:
        known = spark.createDataFrame([("K1",), ("K2",)], "key string")
        stream = new_captures(spark.readStream.schema("id long, text string").parquet(src), known, hot=heavy.hot(spark, 2))
        q = stream.writeStream.foreachBatch(lambda df, n: seen.extend(df.where("key = 'Hot'").groupBy(F.spark_partition_id()).count().collect()) or
                                            seen.append((None, df.count()))).trigger(availableNow=True).option(
            "checkpointLocation", os.path.join(tmp_dir, "ck2")).start()
        q.awaitTermination(300)
    finally:
        for conf in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(conf)
    total, parts = seen[-1][1], [r[1] for r in seen[:-1]]
    assert total == 30_000 - 2 and sum(parts) == 10_000 and len(parts) > 4 and max(parts) < 5_000
    # and in the ingest
    files, _ = _split_events(spark, os.path.join(tmp_dir, "ev"), parts=2) if os.makedirs(os.path.join(tmp_dir, "ev")) is None else None
    text = F.when(F.col("event_id") % 2 == 0, "Busy").otherwise(F.concat(F.lit("Text "), F.col("event_id").cast("string")))
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(files).select("ts", "event_id", text.alias("text"))
    cat, conf, ck, sketch = (os.path.join(tmp_dir, n) for n in ("catalog", "conflicts", "ck", "sketch"))
    run_captures(stream, known, cat, conf, ck, heavy=sketch).awaitTermination(300)
    assert read_catalog(spark, cat).where("key = 'Busy'").count() == 1
    assert sorted(os.listdir(sketch)) == ["batch_id=0", "batch_id=1"] and HeavyKeys(sketch).hot(spark, 9).count() == 1
