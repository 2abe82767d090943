"""Decoding of event envelopes, validation, class tables and feeds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NIL_UUID = "00000000-0000-0000-0000-000000000000"


def canonical_uuid(text: Column) -> Column:
    """Lower case with dashes; 32 hex digits without dashes are good; anything else is the nil id."""
    bare = F.lower(F.replace(text, F.lit("-"), F.lit("")))
    good = F.lower(text).rlike("^([0-9a-f]{32}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$")
    cut = lambda a, n: F.substring(bare, a, n)
    return F.when(good, F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))).otherwise(NIL_UUID)


def severity_of(raw: Column) -> Column:
    return F.coalesce(F.get_json_object(raw, "$.severity_id").try_cast("int"), F.lit(0))


def load_ioc_feed(entries: Column, kind: str) -> Column:
    """The entry trimmed and lower-cased, or null if it is no sha256, IPv4 or IPv6 address (one mapped from IPv4 isn't) or domain, as asked."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    forms = {"sha256": "^[0-9a-f]{64}$", "ipv4": rf"^{octet}(\.{octet}){{3}}$", "domain": r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"}
    text = F.lower(F.trim(entries))
    if kind == "ipv6":
        from sentrylake.functions.predicates import MAPPED, ipv6_hex

        digits = ipv6_hex(text)
        return F.when(digits.isNotNull() & ~F.startswith(digits, F.lit(MAPPED)), text)
    if kind not in forms:
        raise ValueError(f"unknown kind of feed {kind}")
    return F.when(text.rlike(forms[kind]), text)


def ioc_feed(df: DataFrame, kind: str, column: str = "entry") -> DataFrame:
    """The good entries of a feed, each once."""
    return df.select(load_ioc_feed(F.col(column), kind).alias(column)).where(F.col(column).isNotNull()).distinct()


def ioc_stats(entries: DataFrame, feed: str = "feed") -> DataFrame:
    """(feed, entries) of each feed, and of all as "total"."""
    counts = entries.rollup(F.col(feed).alias("_feed")).agg(F.count(F.lit(1)).alias("entries"))
    return counts.select(F.coalesce("_feed", F.lit("total")).alias("feed"), "entries")


def write_events(df: DataFrame, path: str) -> None:
    """Append to day partitions, each file in order of host, time and id."""
    dated = df.withColumn("event_date", F.to_date("observed_at"))
    dated.repartition("event_date", F.pmod(F.xxhash64("host_id"), F.lit(16))).sortWithinPartitions("event_date", "host_id", "observed_at", "event_id").write.mode("append").partitionBy("event_date").parquet(path)


def replay(df: DataFrame, class_uid: int, since: str, until: str) -> DataFrame:
    """Events of one class in the closed window, in order of time and id; bounds are ISO times."""
    if datetime.fromisoformat(since) >= datetime.fromisoformat(until):
        raise ValueError("an empty or inverted window")
    between = F.col("observed_at").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz"))
    return df.where((F.col("class_uid") == class_uid) & between).orderBy("observed_at", "event_id")


def hunt_long(df: DataFrame) -> DataFrame:
    """One row per key of each hunt result; the value is '' where the array is short."""
    keyed = df.select("query_id", "host_id", "observed_at", "values", F.posexplode("columns").alias("pos", "key"))
    return keyed.select("query_id", "host_id", "observed_at", "key", F.coalesce(F.get("values", F.col("pos")), F.lit("")).alias("value"))
