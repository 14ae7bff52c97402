"""Review state machine and language profiles."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from locflow.operators import language as L
from locflow.operators import review as V


def test_review_golden(spark):
    t0 = dt.datetime(2024, 1, 1)
    seq = ["propose", "propose", "accept", "accept", "propose", "decline"]
    rows = [(1, t0 + dt.timedelta(hours=5 * i), i, a) for i, a in enumerate(seq)]
    acts = spark.createDataFrame(rows, "actor long, ts timestamp, event_id long, action string")
    got = [r.outcome for r in V.review_outcomes(acts).orderBy("event_id").collect()]
    assert got == ["opened", "rejected_busy", "accepted", "ignored", "opened", "declined"]
    off = [r.outcome for r in V.review_outcomes(acts, review=False).orderBy("event_id").collect()]
    assert off == ["committed", "committed", "ignored", "ignored", "committed", "ignored"]


def test_review_bucket_does_not_change_result(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    acts = V.actions_from_events(ev)
    a = V.review_outcomes(acts).select("event_id", "outcome")
    b = V.review_outcomes(acts, piece_seconds=86_400 * 7, burst_micros=3_600_000_000).select("event_id", "outcome")
    c = V.review_outcomes(acts, piece_seconds=60, burst_micros=1).select("event_id", "outcome")
    assert a.count() == 5977
    for x in (b, c):
        assert a.exceptAll(x).count() == 0 and x.exceptAll(a).count() == 0


def test_review_burst_is_split_and_exact(spark):
    """One actor, 20,000 events, all but one within ten minutes: many pieces, and the outcomes of a plain lag."""
    t0 = dt.datetime(2024, 1, 1)
    n = 20_000
    acts = spark.range(n).select(
        F.lit(1).cast("long").alias("actor"),
        (F.lit(t0).cast("timestamp") + F.make_interval(secs=F.when(F.col("id") == 0, F.lit(-1e8)).otherwise(F.col("id") * 0.03))).alias("ts"),
        F.col("id").alias("event_id"),
        F.element_at(F.array(F.lit("propose"), F.lit("accept"), F.lit("decline"), F.lit("propose"), F.lit("propose")),
                     (F.col("id") % 5 + 1).cast("int")).alias("action"))
    prev = F.lag("action").over(Window.partitionBy("actor").orderBy("ts", "event_id"))
    want = acts.select("event_id", V.outcome(prev, F.col("action")).alias("outcome"))
    got = V.review_outcomes(acts)
    assert got.count() == n and got.select("event_id", "outcome").exceptAll(want).count() == 0
    micros = F.unix_micros("ts")
    assert acts.select(F.floor(micros / V.BURST_MICROS)).distinct().count() > 50


def test_review_nulls_are_kept(spark):
    acts = spark.createDataFrame([(1, None, 1, "propose"), (None, dt.datetime(2024, 1, 1), 2, "accept")],
                                 "actor long, ts timestamp, event_id long, action string")
    assert sorted(r.outcome for r in V.review_outcomes(acts).collect()) == ["ignored", "opened"]


def test_two_round_top_n_equals_direct(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    prof = L.build_profiles(docs, 50, buckets=7).select("lang", "token", "n")
    counts = (docs.select("lang", F.explode(L.tokens("text")).alias("token"))
              .groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")))
    direct = (counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token")))
              .filter("r <= 50").select("lang", "token", "n"))
    assert prof.count() == direct.count() and prof.exceptAll(direct).count() == 0


def test_detect_override(spark):
    prof = spark.createDataFrame([("en", "the", 1, 1), ("fr", "le", 1, 1)], "lang string, token string, n long, rank long")
    texts = spark.createDataFrame([(1, "the the le", None), (2, "xyz", None), (3, "le", "de")], "id long, text string, o string")
    got = {r.id: (r.detected, r.hits) for r in L.detect_language(texts, prof, ("id",), override_col="o").collect()}
    assert got == {1: ("en", 2), 2: ("und", 0), 3: ("de", 1)}


def test_review_skips_pivot_language_proposals(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=i), i, a, l) for i, (a, l) in
            enumerate([("propose", "cs"), ("propose", "en"), ("accept", None), ("propose", "en"), ("accept", None)])]
    acts = spark.createDataFrame(rows, "actor long, ts timestamp, event_id long, action string, lang string")
    got = [r.outcome for r in V.review_outcomes(acts, skip_review=F.col("lang") == "en").orderBy("event_id").collect()]
    # the English proposals commit at once and do not take the slot the Czech one holds
    assert got == ["opened", "committed", "accepted", "committed", "ignored"]
