"""Late hashes for file events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_followups(events: DataFrame, followups: DataFrame, uid: str = "event_id", correlation: str = "correlation_uid") -> DataFrame:
    """`events` with the sha256 that a follow-up (correlation_uid, sha256) brought later; null where none came.

    Repeats of a follow-up count once (the smallest hash). Follow-ups are no events, so rules never see them.
    """
    late = followups.where(F.col(correlation).isNotNull()).groupBy(F.col(correlation).alias(uid)).agg(F.min("sha256").alias("sha256"))
    return events.drop("sha256").join(late, uid, "left")
