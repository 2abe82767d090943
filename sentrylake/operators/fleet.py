"""Fleet health: host status, tamper chains, load levels and hunt results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.operators.carry import carried

ZERO_HASH = "0" * 64
STRETCH = 100_000  # records of a chain that one task reads


def host_status(last_seen: Column, revoked: Column, now: Column) -> Column:
    """revoked > unknown > online (< 30 s) > stale (< 90 s) > offline."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_seen.cast("timestamp"))
    return F.when(revoked, "revoked").when(last_seen.isNull(), "unknown").when(age < 30_000_000, "online").when(age < 90_000_000, "stale").otherwise("offline")


def record_hash(seq: Column, ts: Column, kind: Column, text: Column, prev: Column) -> Column:
    return F.sha2(F.concat_ws("|", seq.cast("string"), ts, kind, text, prev), 256)


def verify_chain(df: DataFrame, key: str = "host_id", since: Column | None = None) -> DataFrame:
    """First break of each chain and its reason: a gap in seq, a wrong prev_hash or a wrong record_hash; else ok.

    `walked` counts the records before the break that are not older than `since`; older ones are verified all the same.
    A tail that was cut off leaves no trace.
    """
    # a record needs the one before only: long chains are cut by number
    linked = carried(df.withColumn("_us", F.col("seq")), [key], ["_us", "record_hash"], {"_before": F.struct("seq", "record_hash")}, inclusive=False, bucket_us=STRETCH)
    reason = (
        F.when(F.col("seq") != F.coalesce(F.col("_before.seq") + 1, F.lit(0)), "sequence gap")
        .when(F.col("prev_hash") != F.coalesce("_before.record_hash", F.lit(ZERO_HASH)), "prev_hash mismatch")
        .when(F.col("record_hash") != record_hash(F.col("seq"), F.col("ts"), F.col("kind"), F.col("summary"), F.col("prev_hash")), "record_hash mismatch")
    )
    checked = linked.withColumn("reason", reason)
    bad = F.col("reason").isNotNull()
    breaks = checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"), F.min(F.when(bad, F.col("seq"))).alias("broken_at"), F.coalesce(F.min_by("reason", F.when(bad, F.col("seq"))), F.lit("ok")).alias("verdict")
    )
    counted = df.where(F.lit(True) if since is None else F.coalesce(F.col("ts") >= since, F.lit(True)))
    walked = counted.join(breaks, key).where(F.col("broken_at").isNull() | (F.col("seq") < F.col("broken_at"))).groupBy(key).agg(F.count(F.lit(1)).alias("walked"))
    return breaks.join(walked, key, "left").withColumn("walked", F.coalesce("walked", F.lit(0)))


def chain_summaries(records: DataFrame, width: str = "5 minutes", key: str = "host_id", ts: str = "ts") -> DataFrame:
    """Per chain and window: the last seq and its hash, and how many records there are but for the chain's first, chain.init."""
    at = F.window(F.col(ts).cast("timestamp"), width)
    return records.groupBy(key, at.alias("_w")).agg(
        F.max("seq").alias("last_seq"), F.max_by("record_hash", "seq").alias("last_hash"), F.count_if(F.col("kind") != "chain.init").alias("count_observed")
    ).select(key, F.col("_w.start").alias("since_at"), F.col("_w.end").alias("until_at"), "last_seq", "last_hash", "count_observed")


def list_summaries(summaries: DataFrame, n: int = 50, only_mismatch: bool = False, key: str = "host_id", order: str = "received_at") -> DataFrame:
    """The newest n summaries (1..200) of each host, or of those its mismatches only, with their rank."""
    rows = summaries.where("mismatch") if only_mismatch else summaries
    n = 50 if n <= 0 else min(n, 200)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("id")))).where(F.col("rank") <= n)


def apply_heartbeats(hosts: DataFrame, beats: DataFrame) -> DataFrame:
    """hosts (host_id, last_seen, agent_version, ...) after beats (host_id, at, agent_version): the latest time, and the version
    of the latest beat that has one."""
    at = F.struct("at", "agent_version")
    seen = beats.groupBy("host_id").agg(F.max("at").alias("_at"), F.max_by("agent_version", F.when(F.coalesce("agent_version", F.lit("")) != "", at)).alias("_version"))
    joined = hosts.join(seen, "host_id", "left")
    return joined.withColumns({"last_seen": F.greatest("last_seen", "_at"), "agent_version": F.coalesce("_version", "agent_version")}).drop("_at", "_version")


def list_hosts(hosts: DataFrame, only_active: bool = False) -> DataFrame:
    """Hosts by name and id with `active`: known and not revoked."""
    out = hosts.withColumn("active", F.col("revoked_at").isNull())
    return (out.where("active") if only_active else out).orderBy("hostname", "host_id")


def hunt_hosts(hosts: DataFrame, text: str = "") -> DataFrame:
    """Hosts that a hunt goes to: the text is part of the id or the name, case aside; empty means all; revoked ones never."""
    part = F.lit(text.lower())
    found = F.contains(F.lower("host_id"), part) | F.contains(F.lower("hostname"), part)
    return hosts.where(F.col("revoked_at").isNull() & found).select("host_id", "hostname").orderBy("hostname", "host_id")


LEVELS = ["normal", "elevated", "critical"]  # fixed values, ascending


def merge_levels(signals: DataFrame, now: Column, ttl_s: int = 300) -> DataFrame:
    """(host_id, level): the higher of the levels a host's signals (host_id, source, level, since) give, each source's latest
    only; older than `ttl_s` counts as normal."""
    latest = signals.groupBy("host_id", "source").agg(F.max_by("level", "since").alias("level"), F.max("since").alias("since"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))
    rank = F.when(age > ttl_s * 1_000_000, 0).otherwise(F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")) - 1, F.lit(0)))
    return latest.groupBy("host_id").agg(F.max(F.greatest(rank, F.lit(0))).alias("_r")).select("host_id", F.get(F.array(*map(F.lit, LEVELS)), F.col("_r").cast("int")).alias("level"))


def level_changes(counters: DataFrame, elevated: float = 0.005, critical: float = 0.05, key: str = "host_id", order: str = "at") -> DataFrame:
    """Level after each reading of running counters (events, drops), from what came since the one before; the first reading counts from 0."""
    w = Window.partitionBy(key).orderBy(order)
    since = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    grown = counters.withColumns({"_events": since("events"), "_drops": since("drops")})
    level = F.when(F.col("_events") <= 0, "normal").otherwise(load_level(F.col("_drops"), F.col("_events"), elevated, critical))
    return grown.withColumn("level", level).drop("_events", "_drops")


def drop_rate(counters: DataFrame, stage: str = "stage") -> DataFrame:
    """Share of each stage's events that were dropped: dropped / (produced + dropped); 0 where there were none."""
    sums = counters.groupBy(stage).agg(F.sum("produced").alias("produced"), F.sum("dropped").alias("dropped"))
    return sums.withColumn("rate", F.coalesce(F.col("dropped") / F.nullif(F.col("produced") + F.col("dropped"), F.lit(0)), F.lit(0.0)))


def hunt_rows(results: DataFrame, n: int = 100, offset: int = 0) -> DataFrame:
    """A page of hunt results (query_id, host_id, observed_at, columns, values) as maps, oldest first; short rows get ''."""
    filled = F.transform("columns", lambda c, i: F.coalesce(F.get("values", i), F.lit("")))
    ordered = results.orderBy("observed_at", "host_id", "query_id").offset(offset).limit(n)
    return ordered.select("query_id", "host_id", "observed_at", F.map_from_arrays("columns", filled).alias("row"))


def hunt_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id", "host_id").agg(F.count(F.lit(1)).alias("n"))


def load_level(drops: Column, events: Column, elevated: float = 0.005, critical: float = 0.05) -> Column:
    rate = drops / F.nullif(events, F.lit(0))
    return F.when(rate >= critical, "critical").when(rate >= elevated, "elevated").otherwise("normal")


def sample_by_level(df: DataFrame, level: str, id_column: str = "event_id") -> DataFrame:
    """Network and file events are kept at 50 % (elevated) or 10 % (critical) by their ids; other classes always."""
    keep = {"elevated": 500, "critical": 100}.get(level, 1000)
    draw = F.conv(F.substring(F.md5(F.col(id_column).cast("string")), 1, 8), 16, 10).cast("bigint") % 1000
    return df.where(~F.col("class_uid").isin(1001, 4001) | (draw < keep))


def cross_check(summaries: DataFrame, happened: DataFrame, slack: int = 1) -> DataFrame:
    """Counts of a host's chain beside what happened in [since_at, until_at); they mismatch beyond `slack`.

    summaries: (id, host_id, since_at, until_at, count_observed); happened: (host_id, observed_at). An inverted window
    expects nothing and never mismatches. Hours are matched first, so no host's events meet all its windows.
    """
    hour = 3_600_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    good = us("since_at") < us("until_at")
    spans = summaries.where(good).select("id", "host_id", us("since_at").alias("_a"), us("until_at").alias("_b"))
    spread = spans.withColumn("_hour", F.explode(F.sequence(F.floor(F.col("_a") / hour), F.floor((F.col("_b") - 1) / hour))))
    # combined before the join: one row an instant
    seen = happened.groupBy("host_id", us("observed_at").alias("_us")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_hour", F.floor(F.col("_us") / hour))
    met = spread.join(seen, ["host_id", "_hour"]).where("_us >= _a and _us < _b")
    counts = met.groupBy("id").agg(F.sum("_n").alias("_expected"))
    joined = summaries.join(counts, "id", "left").withColumn("count_expected", F.coalesce("_expected", F.lit(0)))
    return joined.withColumn("mismatch", F.coalesce(good & (F.abs(F.col("count_observed") - F.col("count_expected")) > slack), F.lit(False))).drop("_expected")


def hunt_status(hunts: DataFrame, completions: DataFrame, now: Column) -> DataFrame:
    """hunts (id, target_host_count, dispatched_at, timeout_secs) with completed_host_count and status.

    A running hunt is completed once its done hosts reach its targets within the deadline; one without targets, or past the deadline,
    is timed_out. completions: (id, host_id, observed_at); a host counts once.
    """
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    limits = hunts.withColumn("_until", us(F.col("dispatched_at")) + F.col("timeout_secs").cast("bigint") * F.lit(1_000_000))
    first = completions.groupBy("id", "host_id").agg(F.min(us(F.col("observed_at"))).alias("_at"))
    done = first.join(limits.select("id", "_until"), "id").where("_at <= _until").groupBy("id").agg(F.count(F.lit(1)).alias("completed_host_count"))
    joined = limits.join(done, "id", "left").withColumn("completed_host_count", F.coalesce("completed_host_count", F.lit(0)))
    status = (
        F.when(F.col("target_host_count") <= 0, "timed_out")
        .when(F.col("completed_host_count") >= F.col("target_host_count"), "completed")
        .when(us(now) > F.col("_until"), "timed_out")
        .otherwise("running")
    )
    return joined.withColumn("status", status).drop("_until")
