"""Queries of the streaming forms: the events table arrives in parts, out of order, one part a micro-batch."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.plans.catalog import DAY, ORACLE, QUERIES
from sentrylake.plans.detection import PROC, SINCE, starts, stream_view
from sentrylake.plans.telemetry import oracle, telemetry
from sentrylake.sources.classes import STORED
from sentrylake.sources.store import kept, shared_path
from sentrylake.streaming import frames, sinks

PARTS = 5
LAG = 2 * DAY  # seconds that an event comes late at most
DELAY = "3 days"
FILE_ROWS = 250_000  # fixed value: about so many rows of a part go to a file


def in_parts(rows: DataFrame, part: Column, parts: int, n: int, at: str) -> int:
    """Write `rows`, about `n`, to the folders part=0, part=1 ... below `at`, one after the other; gives the files of each, which its
    rows are dealt to: one while parts are small, so that a large part is no single task's."""
    files = math.ceil(max(n, 1) / parts / FILE_ROWS)
    held = kept(rows.withColumn("part", part), "numbered")
    for k in range(parts):
        own = held.where(F.col("part") == k).drop("part")
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.parquet(f"{at}/part={k}")
    return files


def arriving(spark: SparkSession, sf_dir: str, where: str = "true", parts: int = PARTS, closing: bool = False) -> DataFrame:
    """The telemetry view over a stream of `parts` batches or more in order of arrival, an event arriving up to `LAG` after it happened.
    With `closing` a last file event of id -1, 60 days on, lets watermarks pass all others."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet").where(where)
    late = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(LAG))
    bounds = table.agg(F.min(late), F.max(late), F.count(F.lit(1))).first()
    at = shared_path(spark, "arrivals")
    part = F.least(F.lit(parts - 1), F.floor((late - bounds[0]) * parts / (bounds[1] - bounds[0] + 1)))
    files = in_parts(table, part, parts, bounds[2], at)
    if closing:
        last = table.orderBy(F.desc("ts"), F.desc("event_id")).limit(1)
        last.withColumns({"event_id": F.lit(-1).cast("bigint"), "ts": F.col("ts") + F.expr("INTERVAL 60 DAYS"), "event_type": F.lit("view")}).select(*table.columns).write.parquet(f"{at}/part=closing")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(at)
    return stream_view(spark, stream)


def written(rows: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream writes until it has read all."""
    spark, at = rows.sparkSession, shared_path(rows.sparkSession, "stream")
    rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def register_stream(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = build
    ORACLE[name] = oracle(sql)


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.stream_count_hits(arriving(spark, sf_dir), starts(), ["user_name"], DAY, ">", 1, DELAY)
    last = frames.settled(written(rows), F.col("n_hits"))
    return last.select("event_id", F.col("key").alias("user_name"), "n_hits", F.sort_array("event_ids").alias("event_ids"))


COUNTED = f"""WITH c AS (SELECT *, epoch_us(observed_at) AS us FROM t WHERE {PROC}),
w AS (SELECT event_id, user_name, count(*) OVER f AS n_hits, list_sort(list(event_id) OVER f) AS event_ids FROM c WINDOW f AS (PARTITION BY user_name ORDER BY us RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW))
SELECT event_id, user_name, n_hits, event_ids FROM w WHERE n_hits > 1"""
register_stream("d11_stream_late", _counted, COUNTED)


def _equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.stream_count_hits(arriving(spark, sf_dir), starts(), ["user_name"], DAY, "==", 2, DELAY, detail=False)
    return frames.settled(written(rows), F.col("n_hits")).select("event_id", "n_hits")


register_stream("d11_stream_comparison", _equal, f"""WITH c AS (SELECT *, epoch_us(observed_at) AS us FROM t WHERE {PROC}),
w AS (SELECT event_id, count(*) OVER (PARTITION BY user_name ORDER BY us RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW) AS n_hits FROM c) SELECT event_id, n_hits FROM w WHERE n_hits = 2""")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.stream_near(arriving(spark, sf_dir), F.col("class_uid") == 2004, F.col("class_uid") == 4001, 120, delay=DELAY)
    return frames.settled(written(rows), F.col("n_left") + F.col("n_right")).select("event_id", "n_left", "n_right", "event_ids")


register_stream(
    "d11_stream_near", _near,
    """WITH c AS (SELECT *, epoch_us(observed_at) AS us, class_uid = 2004 AS l, class_uid = 4001 AS r FROM t WHERE class_uid IN (2004, 4001)),
w AS (SELECT event_id, count(*) FILTER (WHERE l) OVER f AS n_left, count(*) FILTER (WHERE r) OVER f AS n_right,
      list_sort(list(event_id) FILTER (WHERE l) OVER f) || list_sort(list(event_id) FILTER (WHERE r) OVER f) AS event_ids
      FROM c WINDOW f AS (ORDER BY us RANGE BETWEEN 120000000 PRECEDING AND CURRENT ROW))
SELECT event_id, n_left, n_right, event_ids FROM w WHERE n_left > 0 AND n_right > 0""",
)


def _warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events since a time, warmed by the day before it."""
    live = arriving(spark, sf_dir, f"ts >= TIMESTAMP '{SINCE}'", 3)
    history = telemetry(spark, sf_dir).where(F.col("observed_at") < F.lit(SINCE).cast("timestamp_ntz"))
    rows = frames.stream_count_hits(live, starts(), ["user_name"], DAY, ">", 1, DELAY, detail=False, history=history, since=SINCE, max_lookback_s=DAY)
    return frames.settled(written(rows), F.col("n_hits")).select("event_id", "n_hits")


register_stream(
    "d10_stream_warm", _warm,
    f"""WITH c AS (SELECT *, epoch_us(observed_at) AS us, observed_at >= TIMESTAMP '{SINCE}' AS live FROM t WHERE {PROC}),
w AS (SELECT event_id, live, count(*) OVER f AS n_hits FROM c WINDOW f AS (PARTITION BY user_name ORDER BY us RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW))
SELECT event_id, n_hits FROM w WHERE live AND n_hits > 1""",
)


def _followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File events and, of two thirds of those that have a next event id, a follow-up up to ten minutes later; some follow-ups come too
    late. Last rows far ahead let both watermarks pass."""
    stream = arriving(spark, sf_dir, closing=True)
    table = telemetry(spark, sf_dir)
    ahead = table.agg(F.max("observed_at").alias("observed_at")).select((F.col("observed_at") + F.expr("INTERVAL 60 DAYS")).alias("observed_at"))
    at = shared_path(spark, "late")
    late = table.where("class_uid = 1001 AND event_id % 3 > 0")
    pause = F.make_dt_interval(secs=(F.col("event_id") % 700).cast("double"))
    made = late.select(F.col("event_id").alias("correlation_uid"), F.sha2("raw", 256).alias("sha256"), (F.col("observed_at") + pause).alias("observed_at"))
    files = in_parts(made, F.pmod(F.xxhash64("correlation_uid"), F.lit(3)), 3, late.count(), at)
    ahead.select(F.lit(None).cast("bigint").alias("correlation_uid"), F.lit("").alias("sha256"), "observed_at").coalesce(1).write.parquet(f"{at}/part=9")
    followups = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(at)
    changed = stream.where("class_uid = 1001").select("event_id", "file_path", "observed_at")
    return written(sinks.stream_followups(changed, followups, delay="31 days")).select("event_id", "file_path", "sha256")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class tables written by the stream, the last batch of which comes twice; one event in seventeen has a class that no table has."""
    stream = arriving(spark, sf_dir, parts=3).withColumn("class_uid", F.when(F.col("event_id") % 17 == 0, 9999).otherwise(F.col("class_uid")))
    at = shared_path(spark, "classes")

    def save(df: DataFrame, batch_id: int) -> None:
        sinks.write_batch(df, batch_id, at)
        if batch_id == 2:
            sinks.write_batch(df, batch_id, at)

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start().awaitTermination()
    tables = [sinks.read_class(spark, at, c).select("event_id", "host_id", F.lit(c).alias("class_uid"), F.col("event_date").cast("string").alias("event_date")) for c in STORED]
    dropped = spark.read.parquet(f"{at}/dropped").agg(F.sum("n").alias("n"))
    rows = dropped.select(F.lit(-1).cast("bigint").alias("event_id"), F.lit("dropped").alias("host_id"), F.col("n").cast("int").alias("class_uid"), F.lit(None).cast("string").alias("event_date"))
    for t in tables:
        rows = rows.unionByName(t)
    return rows


register_stream(
    "a10_stream_write", _routed,
    """SELECT event_id, host_id, class_uid, CAST(CAST(observed_at AS DATE) AS VARCHAR) AS event_date FROM t WHERE event_id % 17 <> 0
UNION ALL SELECT -1, 'dropped', count(*)::INT, NULL FROM t WHERE event_id % 17 = 0""",
)


def _beating(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = arriving(spark, sf_dir).where("host_id <> 'host-02' AND event_id % 3 = 0").select(
        "host_id", F.col("observed_at").alias("at"), F.when((F.col("event_id") % 2 == 0) & (F.col("host_id") != "host-06"), F.concat(F.lit("2."), F.col("event_id").cast("string"))).otherwise("").alias("agent_version")
    )
    at = shared_path(spark, "beats")
    sinks.keep_latest(sinks.stream_heartbeats(beats), f"{at}/rows", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return sinks.latest(spark, f"{at}/rows")


register_stream(
    "h2_stream_heartbeats", _beating,
    """WITH b AS (SELECT host_id, observed_at AS seen_at, CASE WHEN event_id % 2 = 0 AND host_id <> 'host-06' THEN '2.' || event_id ELSE '' END AS v FROM t WHERE host_id <> 'host-02' AND event_id % 3 = 0)
SELECT host_id, max(seen_at) AS last_seen, arg_max(v, (seen_at, v)) FILTER (WHERE v <> '') AS agent_version FROM b GROUP BY 1""",
)
register_stream(
    "b11_stream_followups", _followups,
    """SELECT event_id, file_path, CASE WHEN event_id % 3 > 0 AND event_id % 700 <= 600 THEN sha256(raw) END AS sha256 FROM t WHERE class_uid = 1001""",
)
