"""One-slot review of proposals (STM-03), batch form.

Per actor, a proposal opens the slot; a proposal while it is open is refused
(``rejected_busy``); accept commits (``accepted``), decline discards
(``declined``); accept or decline with no open slot is ``ignored``. With
review off every proposal is ``committed`` at once.

The slot after an event is open exactly when that event was a proposal, so
the outcome of an event depends only on the actor's previous event: a
``lag``. Every actor's events are cut into fixed pieces of time, and the
first event of a piece takes the last event of the actor's previous
non-empty piece from a table of one row per piece. No statistics are needed:
a busy actor is spread over as many tasks as it has pieces, and a burst
inside one piece is cut again by the last digits of its time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How the driver's ``events`` map onto review actions.
EVENT_ACTIONS = {"view": "propose", "purchase": "accept", "error": "decline"}


def actions_from_events(events: DataFrame, mapping=EVENT_ACTIONS, actor_col: str = "user_id",
                        ts_col: str = "ts", id_col: str = "event_id",
                        kind_col: str = "event_type") -> DataFrame:
    """``(actor, ts, event_id, action)``; events that are not review actions are dropped."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    # an IN filter on the raw column reaches the Parquet scan as a pushed filter
    return (events.filter(F.col(kind_col).isin(list(mapping)))
                  .select(F.col(actor_col).alias("actor"), F.col(ts_col).alias("ts"),
                          F.col(id_col).alias("event_id"), m[F.col(kind_col)].alias("action")))


def outcome(prev_action, action, review: bool = True):
    if not review:
        return F.when(action == "propose", "committed").otherwise("ignored")
    open_before = F.coalesce(prev_action == "propose", F.lit(False))
    return (F.when(action == "propose", F.when(open_before, "rejected_busy").otherwise("opened"))
             .when(action == "accept", F.when(open_before, "accepted").otherwise("ignored"))
             .when(action == "decline", F.when(open_before, "declined").otherwise("ignored")))


PIECE_SECONDS = 3600        # a piece of an actor's time
BURST_MICROS = 10_000_000   # a piece of a busy piece


def review_outcomes(actions: DataFrame, review: bool = True, skip_review=None,
                    piece_seconds: int = PIECE_SECONDS, burst_micros: int = BURST_MICROS,
                    carried: DataFrame | None = None) -> DataFrame:
    """``(actor, ts, event_id, action, outcome)`` for ``actions(actor, ts, event_id, action)``.

    Two levels of pieces, both by the clock: the lag runs inside an actor's
    ``burst_micros``; the last action of each such piece is one row, and the
    first event of a piece looks back along these rows, inside the actor's
    ``piece_seconds`` and then along the rows of those. So an actor with a
    third of all events, in bursts or not, is spread over many tasks, and what
    one task orders is bounded by the time it covers. The result does not
    depend on the cut. One scan.

    ``skip_review`` is a column predicate for proposals that need no review
    (Q14: texts already in the pivot language); they are ``committed`` at
    once and never touch the slot, so they take no part in the lag.
    """
    skip = F.lit(False)
    if skip_review is not None:
        skip = (F.col("action") == "propose") & F.coalesce(skip_review, F.lit(False))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    piece = lambda size: F.coalesce(F.floor(t / F.lit(size)), F.lit(-(1 << 62)))
    actions = actions.select("*", skip.alias("_skip"), F.lit(False).alias("_carried"))
    if carried is not None:     # without a time it comes before every event of its actor
        actions = actions.unionByName(carried.select("actor", "action", F.lit(False).alias("_skip"), F.lit(True).alias("_carried")),
                                      allowMissingColumns=True)
    a = actions.select("*", piece(burst_micros).alias("_burst"),
                       piece(piece_seconds * 1_000_000).alias("_piece"))
    order = [~F.col("_carried"), F.col("ts"), F.col("event_id")]
    said = F.when(~F.col("_skip"), F.col("action"))      # skipped proposals leave the slot as it was
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_burst = Window.partitionBy("actor", "_piece", "_burst").orderBy(*order)
    a = a.select("*", F.last(said, ignorenulls=True).over(back(in_burst)).alias("_prev"),
                 F.lead(F.lit(1)).over(in_burst).isNull().alias("_ends"))
    # a burst's last row knows its last action; taken from the same window, so both branches read one exchange
    bursts = a.filter("_ends").select("actor", "_piece", "_burst", F.coalesce(said, "_prev").alias("_last"))
    pieces = (bursts.groupBy("actor", "_piece")
                    .agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_burst"))).alias("_last")))
    pieces = pieces.select(F.col("actor").alias("_a"), F.col("_piece").alias("_p"), F.last("_last", ignorenulls=True).over(
        back(Window.partitionBy("actor").orderBy("_piece"))).alias("_before_piece"))
    bursts = bursts.select("actor", "_piece", "_burst", F.last("_last", ignorenulls=True).over(
        back(Window.partitionBy("actor", "_piece").orderBy("_burst"))).alias("_before_burst"))
    # null-safe: an actor may be null, and no filter on it is inferred for one branch alone
    carry = bursts.join(pieces, F.col("actor").eqNullSafe(F.col("_a")) & (F.col("_piece") == F.col("_p")), "left").select(
        F.col("actor").alias("_a"), F.col("_piece").alias("_p"), F.col("_burst").alias("_b"),
        F.coalesce("_before_burst", "_before_piece").alias("_carry"))
    a = a.join(carry, F.col("actor").eqNullSafe(F.col("_a")) & (F.col("_piece") == F.col("_p"))
               & (F.col("_burst") == F.col("_b")), "left")
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    result = F.when(F.col("_skip"), F.lit("committed")).otherwise(outcome(prev, F.col("action"), review))
    return a.where(~F.col("_carried")).select("actor", "ts", "event_id", "action", result.alias("outcome"))
