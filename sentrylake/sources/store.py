"""Sinks and retention of event tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from sentrylake.sources.decode import write_events


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors share; in local sessions without one, under an own folder."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", held)
    return f"{held.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str = "kept") -> DataFrame:
    """`df` written to the shared folder and read back: worked out once, whatever reads it, and safe from lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def stored_events(df: DataFrame) -> DataFrame:
    """`df` written to day partitions and read back."""
    path = shared_path(df.sparkSession, "events")
    write_events(df, path)
    return read_events(df.sparkSession, path, df.schema)


def read_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table of day partitions, with its `event_date`."""
    return spark.read.schema(StructType([*schema.fields, StructField("event_date", DateType())])).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode("append").json(path)


def stored_lines(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "lines")
    write_jsonl(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)


def apply_retention(df: DataFrame, now: Column, days: int = 30, ts: str = "observed_at") -> DataFrame:
    """Rows whose day began less than `days` days and no more before now; whole days go, as partitions do.

    A table with `event_date`, as `write_events` makes it, is cut by that, so that expired partitions aren't read.
    """
    day = F.col("event_date").cast("timestamp") if "event_date" in df.columns else F.date_trunc("day", ts).cast("timestamp")
    return df.where(day + F.make_dt_interval(F.lit(days)) >= now.cast("timestamp"))


def drop_expired(spark: SparkSession, path: str, now: datetime, days: int = 30, partition: str = "event_date") -> list[date]:
    """Delete the day partitions of a table that `apply_retention` would cut, and no other file; gives their days, in order.

    Only the folder's listing is read. Tables of hunt results keep 7 days the same way.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name, _, value = status.getPath().getName().partition("=")
        if name != partition or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            continue
        day = date.fromisoformat(value)
        if datetime.combine(day, time()) + timedelta(days=days) < now:
            fs.delete(status.getPath(), True)
            gone.append(day)
    return sorted(gone)


def discard(*frames: DataFrame | None) -> None:
    """Delete what `kept` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_kept_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(at, True)
