"""Streaming sinks and the streaming forms of late hashes and heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sentrylake.sources.classes import STORED

ROWS, SECONDS = 10_000, 2  # fixed values: rows of a file at most, seconds between flushes


def write_batch(df: DataFrame, batch_id: int, root: str) -> None:
    """Append one micro-batch to the class tables below `root`: class_<uid>/event_date=/batch_id=; rows of unknown classes are
    counted in `dropped`.

    A batch's partitions are its own and are overwritten, so a batch that comes again, as after a lost driver, adds nothing.
    """
    own = df.withColumns({"event_date": F.to_date("observed_at"), "batch_id": F.lit(batch_id).cast("long")})
    cached = own.persist()
    try:
        for class_uid in STORED:
            rows = cached.where(F.col("class_uid") == class_uid)
            # as in batch writing, the files of a day are spread by host, each in order of host, time and id
            dealt = rows.repartition("event_date", F.pmod(F.xxhash64("host_id"), F.lit(4))).sortWithinPartitions("event_date", "host_id", "observed_at", "event_id")
            overwrite(dealt, f"{root}/class_{class_uid}", ["event_date", "batch_id"])
        unknown = cached.where(~F.coalesce(F.col("class_uid").isin(*STORED), F.lit(False))).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
        overwrite(unknown, f"{root}/dropped", ["batch_id"])
    finally:
        cached.unpersist()


def overwrite(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Overwrite just the partitions that `df` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS).partitionBy(*partitions).parquet(path)


def stream_to_classes(stream: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the mixed stream to class tables, flushed every `SECONDS` s in files of at most `ROWS` rows; start it, or set
    another trigger before."""
    return stream.writeStream.foreachBatch(lambda df, batch_id: write_batch(df, batch_id, root)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{SECONDS} seconds")


def read_class(spark: SparkSession, root: str, class_uid: int) -> DataFrame:
    return spark.read.parquet(f"{root}/class_{class_uid}").drop("batch_id")


def stream_followups(events: DataFrame, followups: DataFrame, wait: str = "10 minutes", delay: str = "10 minutes", uid: str = "event_id", correlation: str = "correlation_uid", ts: str = "observed_at") -> DataFrame:
    """Streaming `merge_followups`: events with the sha256 of a follow-up that came up to `wait` after them, else null.

    Events without one come out once the watermarks have passed their wait. A follow-up that is repeated comes out once if both
    copies have one time.
    """
    left = events.drop("sha256").withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    # rows without a correlation match nothing, but move the watermark
    right = followups.select(F.col(correlation).alias("_uid"), "sha256", F.col(ts).cast("timestamp").alias("_at"))
    right = right.withWatermark("_at", delay).dropDuplicates(["_uid", "_at"])
    after = (F.col("_at") >= F.col(ts)) & (F.col("_at") <= F.col(ts) + F.expr(f"INTERVAL {wait}"))
    return left.join(right, (F.col(uid) == F.col("_uid")) & after, "leftOuter").drop("_uid", "_at")


def stream_heartbeats(beats: DataFrame) -> DataFrame:
    """host_id, last_seen, agent_version of each host so far, in update mode: the latest time, and the version of the latest beat
    that has one."""
    at = F.struct("at", "agent_version")
    said = F.when(F.coalesce("agent_version", F.lit("")) != "", at)
    return beats.groupBy("host_id").agg(F.max("at").alias("last_seen"), F.max_by("agent_version", said).alias("agent_version"))


def keep_latest(updates: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of updates (host_id, ...) to `path`, a partition a batch, overwritten if the batch comes again; `latest` reads it."""
    save = lambda df, batch_id: overwrite(df.withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["batch_id"])
    return updates.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, key: str = "host_id") -> DataFrame:
    """Each key's row of its last batch."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in (key, "batch_id")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch_id").alias("_last")).select(key, "_last.*")
