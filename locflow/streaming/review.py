"""One-slot review over a stream of actions (STM-03).

The outcome of an event depends only on the actor's previous action (see
``locflow.operators.review``), so the state per actor is the last action.

* In-order mode (no watermark): each micro-batch sorts an actor's new events
  by ``(ts, event_id)``, shifts the actions by one with the stored action in
  front, and stores the last action. Exact when each actor's events arrive
  in time order.
* Watermark mode (``delay`` given): events wait in the actor's state until
  the watermark passes them, and are then released in ``(ts, event_id)``
  order, so events that arrive out of order (by less than ``delay``) get
  the batch outcomes. An event-time timeout releases what is due when no new
  events come for the actor. The buffer per actor holds at most ``delay``
  worth of its events; events older than the watermark are dropped by Spark
  as late (see ``numRowsDroppedByWatermark``).
* ``run_review``: in-order input whose actors may be busier than a task. Each
  micro-batch is the batch job, which cuts an actor's events by the clock and
  composes the pieces, with the actor's last action of earlier batches in
  front. Only that action is kept, by actor, in files that are read by bucket;
  no Python sees a row.
"""

from __future__ import annotations

import os
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from locflow.operators.review import review_outcomes
from locflow.streaming.ingest import _read_or_none

BUCKETS = 256
LAST_SCHEMA = "actor bigint, action string, batch_id bigint, bucket int"
OUTPUT_SCHEMA = "actor long, ts timestamp, event_id long, action string, outcome string"
STATE_SCHEMA = "last_action string"
BUFFER_STATE_SCHEMA = ("last_action string, buf_ts array<timestamp>, buf_id array<long>, "
                       "buf_action array<string>")
COLUMNS = ["actor", "ts", "event_id", "action", "outcome"]


def _outcomes(prev: pd.Series, action: pd.Series, review: bool) -> pd.Series:
    if not review:
        return action.map(lambda a: "committed" if a == "propose" else "ignored")
    open_before = prev.eq("propose")
    out = pd.Series("ignored", index=action.index, dtype=object)
    out[(action == "propose") & open_before] = "rejected_busy"
    out[(action == "propose") & ~open_before] = "opened"
    out[(action == "accept") & open_before] = "accepted"
    out[(action == "decline") & open_before] = "declined"
    return out


def _decide(batch: pd.DataFrame, last, review: bool) -> pd.DataFrame:
    """Outcomes for time-sorted ``batch`` given the actor's last action before it."""
    prev = batch["action"].shift(1)
    if len(batch):
        prev.iloc[0] = last
    batch = batch.copy()
    batch["outcome"] = _outcomes(prev, batch["action"], review).values
    return batch


def review_stream(actions: DataFrame, review: bool = True, delay: str | None = None,
                  ts_col: str = "ts", skip_review=None) -> DataFrame:
    """Outcomes for a streaming ``actions(actor, ts, event_id, action)`` DataFrame.

    ``skip_review`` as in the batch form (Q14): such proposals are committed
    at once, outside the actor's state.
    """
    if skip_review is not None:
        skip = (F.col("action") == "propose") & F.coalesce(skip_review, F.lit(False))
        direct = actions.filter(skip).select("actor", F.col(ts_col).cast("timestamp").alias("ts"), "event_id",
                                             "action", F.lit("committed").alias("outcome"))
        return review_stream(actions.filter(~skip), review, delay, ts_col).unionByName(direct)
    if delay is None:
        return _in_order(actions, review)
    # withWatermark refuses timestamp_ntz (the driver's events.ts); the session zone is UTC
    ts = actions.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return _buffered(ts.withWatermark(ts_col, delay), review)


def _in_order(actions: DataFrame, review: bool) -> DataFrame:
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        last = state.get[0] if state.exists else None
        out = _decide(batch, last, review)
        state.update((batch["action"].iloc[-1] if len(batch) else last,))
        yield out[COLUMNS]

    return actions.groupBy("actor").applyInPandasWithState(
        step, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def _buffered(actions: DataFrame, review: bool) -> DataFrame:
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        actor = key[0]
        if state.exists:
            last, b_ts, b_id, b_act = state.get
            buf = pd.DataFrame({"ts": pd.to_datetime(list(b_ts or [])), "event_id": list(b_id or []),
                                "action": list(b_act or [])})
        else:
            last, buf = None, pd.DataFrame({"ts": pd.to_datetime([]), "event_id": [], "action": []})
        frames = [buf] + [p[["ts", "event_id", "action"]] for p in pdfs]
        allrows = pd.concat(frames, ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        wm = state.getCurrentWatermarkMs()
        due_mask = allrows["ts"].astype("int64") // 1_000_000 <= wm if wm > 0 else allrows["ts"].isna()
        due, keep = allrows[due_mask], allrows[~due_mask]
        out = _decide(due.reset_index(drop=True), last, review)
        out.insert(0, "actor", actor)
        if len(due):
            last = due["action"].iloc[-1]
        if len(keep):
            state.update((last, list(keep["ts"]), [int(x) for x in keep["event_id"]], list(keep["action"])))
            state.setTimeoutTimestamp(int(keep["ts"].iloc[0].value // 1_000_000) + 1)
        else:
            state.update((last, [], [], []))
        yield out[COLUMNS]

    return actions.groupBy("actor").applyInPandasWithState(
        step, OUTPUT_SCHEMA, BUFFER_STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def _last_actions(spark, path: str, batch_id: int, buckets: list[int]) -> DataFrame:
    """``actor, action``: the last action of every actor of these buckets before ``batch_id``."""
    kept = _read_or_none(spark, path, LAST_SCHEMA)
    if kept is None:
        return spark.createDataFrame([], "actor bigint, action string")
    kept = kept.where((F.col("batch_id") < batch_id) & F.col("bucket").isin(*buckets))
    return kept.groupBy("actor").agg(F.max_by("action", "batch_id").alias("action"))


def review_batch(actions: DataFrame, batch_id: int, out_path: str, last_path: str, review: bool = True, skip_review=None) -> None:
    """One micro-batch: its outcomes, and its actors' last actions, each into the folder of its id."""
    spark = actions.sparkSession
    actions = actions.persist()
    try:
        bucket = F.pmod(F.xxhash64("actor"), F.lit(BUCKETS)).cast("int")
        buckets = [r[0] for r in actions.select(bucket.alias("b")).distinct().collect()]     # at most BUCKETS numbers
        before = _last_actions(spark, last_path, batch_id, buckets)
        mine = before.join(actions.select(F.col("actor").alias("a")).distinct(), F.col("actor").eqNullSafe(F.col("a")), "left_semi")
        out = review_outcomes(actions, review, skip_review, carried=mine)
        out.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))
        said = actions if skip_review is None else actions.where(~((F.col("action") == "propose") & F.coalesce(skip_review, F.lit(False))))
        last = said.groupBy("actor").agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"))
        (last.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
             .parquet(os.path.join(last_path, f"batch_id={batch_id}")))
    finally:
        actions.unpersist()


def run_review(actions: DataFrame, out_path: str, last_path: str, checkpoint: str, review: bool = True, skip_review=None,
               available_now: bool = True):
    """Start the review of a streaming ``actions(actor, ts, event_id, action)``; returns the ``StreamingQuery``.

    Outcomes lie in ``out_path/batch_id=<n>``. Events of one actor must not
    come earlier in time than those of batches before; a replayed batch
    writes the same rows again.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        review_batch(batch, batch_id, out_path, last_path, review, skip_review)

    w = actions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
