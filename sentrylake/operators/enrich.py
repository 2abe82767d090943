"""Enrichment of raw events: direction, process state, actors, users and path filters."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.operators.carry import carried, followed
from sentrylake.operators.correlate import micros
from sentrylake.sources.store import kept

# Protocol names, and the activity of each raw kind by family.
PROTOCOLS = {6: "tcp", 17: "udp", 1: "icmp"}
ACTIVITIES = {
    "process": {"exec": 1, "fork": 1, "exit": 2},
    "file": {"open_create": 1, "open_write": 3, "unlink": 4, "rename": 6, "chmod": 5, "chown": 7},
    "network": {"tcp_connect": 1, "tcp_accept": 1, "udp_send": 6},
}
OTHER = 99


def map_activity(kind: Column, family: str) -> tuple[Column, Column]:
    """Activity number and event code of a raw kind; an unknown kind is 99 and "unknown"."""
    known = ACTIVITIES[family]
    activity, code = F.lit(OTHER), F.lit("unknown")
    for name, number in known.items():
        activity = F.when(kind == name, number).otherwise(activity)
    return activity, F.when(kind.isin(*known), kind).otherwise(code)


def normalise_net(df: DataFrame, kind: str = "kind", proto: str = "proto") -> DataFrame:
    """Direction (connect and send outbound 2, accept inbound 1, else 0), protocol name, and for accepts source and
    destination exchanged, so that the source is who began."""
    k = F.col(kind)
    direction = F.when(k.isin("tcp_connect", "udp_send"), 2).when(k == "tcp_accept", 1).otherwise(0)
    named = F.lit("")
    for number, name in PROTOCOLS.items():
        named = F.when(F.col(proto) == number, name).otherwise(named)
    taken = k == "tcp_accept"
    ends = {f"{a}_{part}": F.when(taken, F.col(f"{b}_{part}")).otherwise(F.col(f"{a}_{part}")) for a, b in (("src", "dst"), ("dst", "src")) for part in ("ip", "port")}
    return df.withColumns(ends | {"direction": direction, "protocol": named})


def parent_chain(procs: DataFrame, depth: int = 8) -> DataFrame:
    """(host_id, pid, parents) of each process: its ancestors, nearest first, at most `depth`, as (pid, exec_path).

    A parent that isn't known ends the chain by its pid alone; pid 0 is no parent. The table of processes is worked out
    once; each level joins only the chains that still grow.
    """
    from sentrylake.operators.graph import first_seen

    known = kept(first_seen(procs).select("host_id", "pid", "parent_pid", "exec_path"), "processes")
    up = known.select("host_id", F.col("pid").alias("_next"), F.col("parent_pid").alias("_above"), F.col("exec_path").alias("_path"), F.lit(True).alias("_known"))
    none = F.array().cast("array<struct<pid: bigint, exec_path: string>>")
    growing = known.select("host_id", "pid", none.alias("parents"), F.col("parent_pid").alias("_next"))
    done = growing.where("coalesce(_next, 0) = 0").drop("_next")
    growing = growing.where("_next <> 0")
    for _ in range(depth):
        step = growing.join(up, ["host_id", "_next"], "left").withColumn("parents", F.concat("parents", F.array(F.struct(F.col("_next").alias("pid"), F.col("_path").alias("exec_path")))))
        step = kept(step.select("host_id", "pid", "parents", F.when(F.col("_known"), F.col("_above")).alias("_next")), "chains")
        done = done.unionByName(step.where("coalesce(_next, 0) = 0").drop("_next"))
        growing = step.where("_next <> 0")
        if growing.isEmpty():
            return done
    return done.unionByName(growing.drop("_next"))


def type_uid(class_uid: Column, activity: Column) -> Column:
    return class_uid * 100 + activity


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mode_text(mode: Column) -> Column:
    return F.concat(F.lit("mode:0"), F.conv(mode.cast("string"), 10, 8))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two feeds as one; what one lacks is null."""
    return a.unionByName(b, allowMissingColumns=True)


def carry_state(df: DataFrame, fields: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Each field's last value that was not empty, so far in its key; created_at keeps the first time. `order` begins with a time."""
    timed = df.withColumn("_us", micros(F.col(order[0])))
    values = {f"_last_{f}": F.when(F.col(f).cast("string") != "", F.col(f)) for f in fields}
    seen = carried(timed, keys, ["_us", *order[1:]], values)
    first = df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min("observed_at").alias("created_at"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    both = seen.drop("created_at").join(first, on)
    return both.select(*[F.col(f"_last_{c}").alias(c) if c in fields else F.col(c) for c in df.columns if c != "created_at"], "created_at")


def intervals(df: DataFrame, keys: list[str], grace_s: int = 30) -> DataFrame:
    """[start, end) in microseconds of each state: until the key's next event, or `grace_s` after an exit."""
    timed = df.withColumn("_us", micros(F.col("observed_at")))
    grace = F.col("_us") + grace_s * 1_000_000
    end = F.when(F.col("is_exit"), F.least(F.coalesce("_after", grace), grace)).otherwise(F.col("_after"))
    return followed(timed, keys, "event_id", "_after").withColumns({"start_us": F.col("_us"), "end_us": end}).drop("_us", "_after")


def path_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes win; no include means all; dir/** is the folder and all below; other globs stop at a slash."""

    def one(p: str) -> Column:
        if p.endswith("/**"):
            return (path == p[:-3]) | F.startswith(path, F.lit(p[:-2]))
        if re.search(r"[*?\[]", p):
            parts = re.split(r"([*?])", p)
            body = "".join("[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x).replace(r"\[", "[").replace(r"\]", "]").replace(r"\-", "-") for x in parts)
            return path.rlike(f"^{body}$")
        return path == p

    any_of = lambda ps: reduce(or_, map(one, ps))
    keep = any_of(include) if include else F.lit(True)
    return F.coalesce(keep & ~any_of(exclude) if exclude else keep, F.lit(False))


def resolve_path(path: Column, cwd: Column) -> Column:
    """Absolute path without . and .. parts."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", cwd, path))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def join_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """User name of each uid; unknown ids stay without one."""
    return df.join(users.select("uid", F.col("name").alias("user")), "uid", "left")


def stamp_host(df: DataFrame, host: str) -> DataFrame:
    return df.withColumn("host_id", F.lit(host))
