"""Streaming correlation that equals the batch result in any order of arrival within the watermark.

A hit goes to the state of its key's slot and time bucket and of the next bucket, buckets being as wide as the frame: whatever a
frame [t - w, t] can hold is then in one state, and no state gathers more than two frames. Keys share `SLOTS` states a bucket, as
a state of its own for every key would be called, and timed out, once a key and bucket for a hit or two; a batch reads the held
hits of the slots that it has hits of. A
hit that comes late also changes the counts of events after it that were already seen; these are sent again. A bucket's
state goes when the watermark has passed its end, as nothing for it can come any more.
"""

from __future__ import annotations

import operator
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentrylake.operators.correlate import NIL

OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["key", "event_id", "n_left", "n_right", "window_us", "event_ids", "fires", "revised"]


#: Fixed value: states of a bucket over which keys are dealt by hash.
SLOTS = 64


class FrameHits(StatefulProcessor):
    """The hits of one slot of keys and bucket. `test` takes the counts of both sides; with `ids`, rows list their frame's events."""

    def __init__(self, width: int, test, ids: bool, id_type: str):
        self.width, self.test, self.ids, self.id_type = width, test, ids, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", f"key string, us long, event_id {self.id_type}, own boolean, l boolean, r boolean")

    def _take(self, key: tuple, frames: Iterator[pd.DataFrame]) -> list[tuple]:
        new = [row for frame in frames for row in frame[["key", "us", "event_id", "own", "l", "r"]].itertuples(index=False, name=None)]
        self.hits.appendList(new)
        self.handle.registerTimer((key[1] + 1) * self.width // 1000)
        return new

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        """Hits of the history: they count, but never fire."""
        self._take(key, iter([initialState.assign(own=False)]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.hits.get()] if self.hits.exists() else []
        new: dict[str, list[tuple]] = {}
        for own, *hit in self._take(key, rows):
            new.setdefault(own, []).append(tuple(hit))
        old: dict[str, list[tuple]] = {k: [] for k in new}
        for own, *hit in held:
            if own in old:
                old[own].append(tuple(hit))
        yield pd.DataFrame([row for k in new for row in self._found(k, old[k], new[k])], columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        return iter([])

    def _found(self, key: str, held: list[tuple], new: list[tuple]) -> Iterator[tuple]:
        """Rows of the new events that fire, and of the older ones whose counts have changed and that fire, or did."""
        hits = sorted([(*h, True) for h in held] + [(*h, False) for h in new], key=lambda h: (h[0], h[1]))
        at = [h[0] for h in hits]
        sums = [list(accumulate((test(h) for h in hits), initial=0)) for test in (lambda h: h[3], lambda h: h[4], lambda h: h[3] and h[5], lambda h: h[4] and h[5], lambda h: h[5])]
        first, last = min(h[0] for h in new), max(h[0] for h in new)
        for k in range(bisect_left(at, first), bisect_right(at, last + self.width)):
            us, event_id, own, _, _, older = hits[k]
            low, high = bisect_left(at, us - self.width), bisect_right(at, us)
            left, right, left_before, right_before, before = (s[high] - s[low] for s in sums)
            if not own or before == high - low:
                continue
            fires = self.test(left, right)
            if fires or (older and self.test(left_before, right_before)):
                frame = hits[low:high] if self.ids else []
                ids = sorted(h[1] for h in frame if h[3]) + sorted(h[1] for h in frame if h[4])
                yield key, event_id, left, right, at[low], ids, fires, older


def _spread(df: DataFrame, left: Column, right: Column, by: list[str], width: int, ts: str, id_column: str) -> DataFrame:
    """Hits with their buckets. Rows that are no hits go by the explode, not by a filter, so that they still move the watermark."""
    keys = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit(NIL)) for c in by])
    flagged = df.select(keys.alias("key"), F.col(id_column).alias("event_id"), F.col(ts).cast("timestamp").alias("at"), F.coalesce(left, F.lit(False)).alias("l"), F.coalesce(right, F.lit(False)).alias("r"))
    us = F.unix_micros("at")
    own = F.floor(us / width)
    buckets = F.when(F.col("l") | F.col("r"), F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array())
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS))
    return flagged.withColumn("us", us).withColumn("_x", F.explode(buckets)).select(slot.alias("slot"), "key", F.col("_x.b").alias("bucket"), "event_id", "at", "us", F.col("_x.own").alias("own"), "l", "r")


def _frames(stream: DataFrame, history: DataFrame | None, left: Column, right: Column, by: list[str], seconds: int, test, ids: bool, delay: str, ts: str, id_column: str) -> DataFrame:
    spark, width = stream.sparkSession, seconds * 1_000_000
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    id_type = stream.schema[id_column].dataType.simpleString()
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    hits = _spread(timed, left, right, by, width, ts, id_column)
    initial = None if history is None else _spread(history, left, right, by, width, ts, id_column).groupBy("slot", "bucket")
    out = f"key string, event_id {id_type}, n_left long, n_right long, window_us long, event_ids array<{id_type}>, fires boolean, revised boolean"
    return hits.groupBy("slot", "bucket").transformWithStateInPandas(FrameHits(width, test, ids, id_type), out, "Append", "EventTime", initialState=initial)


class AtLeast:
    """Tests of counts that can be sent to the workers."""

    def __init__(self, op: str, n: int):
        self.op, self.n = op, n

    def __call__(self, left: int, right: int) -> bool:
        return OPS[self.op](left, self.n)


def both_sides(left: int, right: int) -> bool:
    return left > 0 and right > 0


def last_frame(history: DataFrame, seconds: int, since, max_lookback_s: int, ts: str = "observed_at") -> DataFrame | None:
    """What a warm start needs of the history: the frame before `since`; none for frames wider than `max_lookback_s`."""
    if seconds > max_lookback_s:
        return None
    start = F.lit(since).cast("timestamp")
    return history.where((F.col(ts).cast("timestamp") < start) & (F.col(ts).cast("timestamp") >= start - F.make_dt_interval(secs=F.lit(float(seconds)))))


def stream_count_hits(
    stream: DataFrame, where: Column, by: list[str], seconds: int, op: str = ">", n: int = 1, delay: str = "10 minutes", ts: str = "observed_at", id_column: str = "event_id", detail: bool = True,
    history: DataFrame | None = None, since=None, max_lookback_s: int = 3600,
) -> DataFrame:
    """Streaming `count_over`: key, event_id, n_hits, window_start, event_ids, fires, revised.

    An event's row comes with its batch; `revised` rows replace an earlier one as late hits have changed its count, and `fires`
    is false where it no longer satisfies the test. The row with the most hits is the last one. With `history` and
    `since` the first batch counts as if the frame before `since` had been seen.
    """
    warm = None if history is None else last_frame(history, seconds, since, max_lookback_s, ts)
    rows = _frames(stream, warm, where, F.lit(False), by, seconds, AtLeast(op, n), detail, delay, ts, id_column)
    return rows.select("key", "event_id", F.col("n_left").alias("n_hits"), F.timestamp_micros("window_us").alias("window_start"), "event_ids", "fires", "revised")


def stream_near(
    stream: DataFrame, left: Column, right: Column, seconds: int, by: list[str] | None = None, delay: str = "10 minutes", ts: str = "observed_at", id_column: str = "event_id", detail: bool = True,
    history: DataFrame | None = None, since=None, max_lookback_s: int = 3600,
) -> DataFrame:
    """Streaming `near`: key, event_id, n_left, n_right, window_start, event_ids, revised; without `by` over all hosts.

    As with `stream_count_hits`, the row of an event with the most hits is the last one.
    """
    warm = None if history is None else last_frame(history, seconds, since, max_lookback_s, ts)
    rows = _frames(stream, warm, left, right, by or [], seconds, both_sides, detail, delay, ts, id_column)
    return rows.select("key", "event_id", "n_left", "n_right", F.timestamp_micros("window_us").alias("window_start"), "event_ids", "revised")


def settled(rows: DataFrame, count: Column) -> DataFrame:
    """The last row of each event of what a stream of `stream_count_hits` or `stream_near` has written."""
    names = [c for c in rows.columns if c != "event_id"]
    last = rows.groupBy("event_id").agg(F.max_by(F.struct(*names), count).alias("_last")).select("event_id", "_last.*")
    return last.where("fires") if "fires" in names else last
