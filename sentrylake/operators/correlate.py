"""Stateful correlation over event time: sliding counts per key and two-sided temporal joins.

Each match counts in every frame [t - w, t] that holds it. Time is cut into buckets of the frame's width; a match is
handed to its own bucket and the next, so that a frame never needs more than one bucket and a hot (or no) key is spread
over time.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
NIL = "<nil>"  # fixed value: the key part of an absent field


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _carried(df: DataFrame, seconds: int) -> DataFrame:
    w = seconds * 1_000_000
    own = F.floor(F.col("_us") / w)
    return df.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(own, own + 1)))


def count_over(
    df: DataFrame, where: Column, by: list[str], seconds: int, op: str = ">", n: int = 1, ts: str = "observed_at", id_column: str = "event_id", detail: bool = True, ties: str = "all"
) -> DataFrame:
    """Matching events at which the count of matches of their key in the closed frame [t - w, t] satisfies `op n`.

    Adds key columns k0.. (absent parts are '<nil>'), n_hits and, with detail, window_start and event_ids of the frame.
    Of events at one time all count; with ties="arrival" those up to the event itself, by id. Ids are listed for events
    that fire only, by a join of these with their frame's bucket.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit(NIL)).alias(f"k{i}") for i, c in enumerate(by)]
    names = [f"k{i}" for i in range(len(by))]
    width = seconds * 1_000_000
    hits = df.where(where).select("*", *keys, micros(F.col(ts)).alias("_us"))
    spread = _carried(hits, seconds)
    frame = Window.partitionBy(*names, "_bucket").orderBy("_us").rangeBetween(-width, 0)
    counted = spread.withColumn("n_hits", F.count(F.lit(1)).over(frame))
    if ties == "arrival":
        peers = Window.partitionBy(*names, "_bucket", "_us")
        later = F.count(F.lit(1)).over(peers) - F.row_number().over(peers.orderBy(id_column))
        counted = counted.withColumn("n_hits", F.col("n_hits") - later)
    if detail:
        counted = counted.withColumn("window_start", F.min(ts).over(frame))
        counted = counted.withColumn("event_ids", _frame_ids(F.lit(True), frame, id_column, ties == "arrival"))
    fired = counted.where((F.col("_own") == F.col("_bucket")) & OPS[op](F.col("n_hits"), n))
    return fired.drop("_us", "_own", "_bucket")


def _frame_ids(flag: Column, frame: WindowSpec, id_column: str, arrival: bool = False) -> Column:
    """Sorted ids of the frame's hits that satisfy the flag, listed where the frame is counted, so that no pair of events is moved.

    With `arrival` hits at the event's own time count up to its id.
    """
    if not arrival:
        return F.sort_array(F.collect_list(F.when(flag, F.col(id_column))).over(frame))
    held = F.collect_list(F.when(flag, F.struct(F.col("_us").alias("at"), F.col(id_column).alias("id")))).over(frame)
    return F.sort_array(F.transform(F.filter(held, lambda x: (x["at"] < F.col("_us")) | (x["id"] <= F.col(id_column))), lambda x: x["id"]))


def count_over_warm(live: DataFrame, history: DataFrame, where: Column, by: list[str], seconds: int, op: str = ">", n: int = 1, ts: str = "observed_at", max_lookback_s: int = 3600) -> DataFrame:
    """`count_over` of the live events as if the history of the last frame before them had been seen; only live events fire.

    A frame wider than `max_lookback_s` starts cold.
    """
    if seconds > max_lookback_s:
        return count_over(live, where, by, seconds, op, n, ts, detail=False)
    first = live.agg(F.min(micros(F.col(ts))).alias("_first"))
    # one row
    recent = history.join(F.broadcast(first), micros(F.col(ts)) >= F.col("_first") - seconds * 1_000_000).drop("_first")
    both = live.withColumn("_live", F.lit(True)).unionByName(recent.withColumn("_live", F.lit(False)))
    return count_over(both, where, by, seconds, op, n, ts, detail=False).where("_live").drop("_live")


def near(
    df: DataFrame, left: Column, right: Column, seconds: int, by: list[str] | None = None, ts: str = "observed_at", id_column: str = "event_id", detail: bool = True
) -> DataFrame:
    """Events of either side at which both sides have a hit in [t - w, t]; without `by` over all hosts.

    Adds n_left, n_right and, with detail, window_start and event_ids, the left ids and then the right ones; ids are listed for
    events that fire only.
    """
    names, width = [f"k{i}" for i in range(len(by or []))], seconds * 1_000_000
    keys = [F.coalesce(F.col(c).cast("string"), F.lit(NIL)).alias(f"k{i}") for i, c in enumerate(by or [])]
    hits = df.withColumns({"_l": left, "_r": right}).where("_l or _r").select("*", *keys, micros(F.col(ts)).alias("_us"))
    spread = _carried(hits, seconds)
    frame = Window.partitionBy(*names, "_bucket").orderBy("_us").rangeBetween(-width, 0)
    counts = {"n_left": F.count_if("_l").over(frame), "n_right": F.count_if("_r").over(frame)} | ({"window_start": F.min(ts).over(frame)} if detail else {})
    if detail:
        counts["event_ids"] = F.concat(_frame_ids(F.col("_l"), frame, id_column), _frame_ids(F.col("_r"), frame, id_column))
    fired = spread.withColumns(counts).where("_own = _bucket and n_left > 0 and n_right > 0")
    return fired.drop("_us", "_own", "_bucket", "_l", "_r")
