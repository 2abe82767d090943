"""Streaming forms: live tail, sliding counts and alert de-duplication with state and event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sentrylake.streaming.frames import stream_count_hits


def live_tail(
    stream: DataFrame, host: str = "", class_uid: int | None = None, text: str = "", max_age: str = "1 minute", ts: str = "observed_at", now: Column | None = None
) -> DataFrame:
    """Events by part of a host's name, class and part of the payload; those older than `max_age` go."""
    out = stream.where(F.col(ts).cast("timestamp") >= (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {max_age}"))
    if host:
        out = out.where(F.contains(F.lower("host_id"), F.lit(host.lower())))
    if class_uid is not None:
        out = out.where(F.col("class_uid") == class_uid)
    return out.where(F.contains("raw", F.lit(text))) if text else out


def _arrived(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["us", "event_id"], kind="stable")


def stream_count_over(stream: DataFrame, by: str, seconds: int, n: int, delay: str = "10 minutes", ts: str = "observed_at") -> DataFrame:
    """(key, event_id, n_hits) of events at which more than `n` of their key fall in [t - w, t], as they come; an event is sent
    again with its new count when a late one falls into its frame."""
    rows = stream_count_hits(stream, F.lit(True), [by], seconds, ">", n, delay, ts, detail=False)
    return rows.where("fires").select("key", "event_id", "n_hits")


def stream_dedupe(stream: DataFrame, keys: list[str], seconds: int, delay: str = "10 minutes", ts: str = "observed_at") -> DataFrame:
    """Event ids of the alerts that are kept: none younger than `seconds` than the last kept one of its keys."""
    width = seconds * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = []
        for us, event_id in _arrived(frames)[["us", "event_id"]].itertuples(index=False):
            if last is None or last <= us - width:
                last = us
                rows.append((event_id,))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["event_id"])

    timed = stream.select(*keys, "event_id", F.col(ts).cast("timestamp").alias("at")).withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    return timed.groupBy(*keys).applyInPandasWithState(run, "event_id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
