"""Processes in time: live states of reused pids, actors and parent chains as of an event, children and trees of a window.

What was last before a time, over any span, comes from `carry.carried`: no range is joined, and a pid that is never silent is
spread over days.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sentrylake.operators.carry import carried, followed
from sentrylake.operators.correlate import micros
from sentrylake.operators.graph import as_of
from sentrylake.sources.store import kept

def live_states(df: DataFrame, fields: list[str], is_exit: Column, keys: tuple[str, ...] = ("host_id", "pid"), grace_s: int = 30, ts: str = "observed_at", id_column: str = "event_id") -> DataFrame:
    """The state that each event of a process leaves: keys, `fields` carried on, created_at, start_us, end_us, is_exit.

    A field keeps its last value that wasn't empty or zero. A state ends with the next event of its key, or, after an exit, when
    `grace_s` have passed; an event after that begins a new process, which takes nothing over, while one within it revives
    the old one. end_us is null where nothing came after.
    """
    order = ["_us", id_column]
    rows = df.withColumns({"_us": micros(F.col(ts)), "is_exit": F.coalesce(is_exit, F.lit(False))}).select(*keys, id_column, ts, "_us", "is_exit", *fields)
    seen = carried(rows, list(keys), order, {"_prior": F.struct("is_exit", "_us")}, inclusive=False)
    anew = F.col("_prior").isNull() | (F.col("_prior.is_exit") & (F.col("_us") - F.col("_prior._us") > grace_s * 1_000_000))
    # what was carried is of this process if it is no older than the process's first event
    values = {"_gen": F.when(anew, F.struct("_us", F.col(ts).alias("at")))}
    for f in fields:
        absent = F.lit("") if isinstance(df.schema[f].dataType, StringType) else F.lit(0)
        values[f"_last_{f}"] = F.when(F.col(f) != absent, F.struct(F.col(f).alias("v"), "_us"))
    named = carried(seen, list(keys), order, values)
    named = named.withColumns({f: F.when(F.col(f"_last_{f}._us") >= F.col("_gen._us"), F.col(f"_last_{f}.v")) for f in fields})
    ended = followed(named, list(keys), id_column, "_next")
    grace = F.col("_us") + grace_s * 1_000_000
    end = F.when(F.col("is_exit"), F.least(F.coalesce("_next", grace), grace)).otherwise(F.col("_next"))
    return ended.select(*keys, id_column, ts, *fields, F.col("_gen.at").alias("created_at"), F.col("_us").alias("start_us"), end.alias("end_us"), "is_exit")


def state_at(probes: DataFrame, states: DataFrame, values: list[str], grace_s: int = 30, probe: str = "event_id", keys: tuple[str, ...] = ("host_id", "pid")) -> DataFrame:
    """`values` of the state of each probe's process that is live at its time, null where there is none or it has gone.

    probes: probe id, keys, _us; states from `live_states`. Gives the probe id, keys, _us, `known` and the values.
    """
    packed = F.struct(F.col("start_us").alias("_start"), F.when(F.col("is_exit"), F.col("start_us") + grace_s * 1_000_000).alias("_until"), *values)
    kind = states.select(packed.alias("s")).schema["s"].dataType
    id_kind = probes.schema[probe].dataType
    asked = probes.select(*keys, "_us", F.col(probe).alias("_probe"), F.lit(1).alias("_tag"), F.lit(None).cast("string").alias("_tie"), F.lit(None).cast(kind).alias("_state"))
    # of the events of one time, the last by id counts
    held = states.select(*keys, F.col("start_us").alias("_us"), F.lit(None).cast(id_kind).alias("_probe"), F.lit(0).alias("_tag"), F.lpad(F.col("event_id").cast("string"), 24, "0").alias("_tie"), packed.alias("_state"))
    found = carried(asked.unionByName(held), list(keys), ["_us", "_tag", "_tie"], {"_last": F.col("_state")}).where("_tag = 1")
    live = F.col("_last").isNotNull() & (F.col("_last._until").isNull() | (F.col("_us") <= F.col("_last._until")))
    return found.select(F.col("_probe").alias(probe), *keys, "_us", live.alias("known"), *[F.when(live, F.col(f"_last.{v}")).alias(v) for v in values])


def join_actor_live(events: DataFrame, states: DataFrame, values: list[str], ts: str = "observed_at", grace_s: int = 30) -> DataFrame:
    """event_id, actor_pid, known and actor_<value> of file and network events: the live state of their pid at their time; where there
    is none, the pid alone."""
    found = state_at(events.select("event_id", "host_id", "pid", micros(F.col(ts)).alias("_us")), states, values, grace_s)
    return found.select("event_id", F.col("pid").alias("actor_pid"), "known", *[F.col(v).alias(f"actor_{v}") for v in values])


def parent_chain_live(events: DataFrame, states: DataFrame, depth: int = 8, ts: str = "observed_at", grace_s: int = 30) -> DataFrame:
    """event_id and parents of each process event: (pid, exec_path) of its ancestors as they live at its time, nearest first, at
    most `depth`; one that isn't known ends the chain by its pid alone, pid 0 is none. Events need parent_pid.

    Each level looks up only the chains that still grow.
    """
    none = F.array().cast("array<struct<pid: bigint, exec_path: string>>")
    held = kept(states, "states")
    growing = events.select("event_id", "host_id", F.col("parent_pid").alias("pid"), micros(F.col(ts)).alias("_us"), none.alias("parents"))
    done = growing.where("coalesce(pid, 0) = 0").select("event_id", "parents")
    growing = growing.where("pid <> 0")
    for _ in range(depth):
        found = state_at(growing, held, ["exec_path", "parent_pid"], grace_s)
        step = growing.join(found.select("event_id", "exec_path", F.col("parent_pid").alias("_up")), "event_id")
        grown = F.concat("parents", F.array(F.struct("pid", "exec_path")))
        step = kept(step.select("event_id", "host_id", F.col("_up").alias("pid"), "_us", grown.alias("parents")), "chains")
        done = done.unionByName(step.where("coalesce(pid, 0) = 0").select("event_id", "parents"))
        growing = step.where("pid <> 0")
        if growing.isEmpty():
            return done
    return done.unionByName(growing.select("event_id", "parents"))


def ancestors_at(procs: DataFrame, probes: DataFrame, lookback_s: int = 86_400, depth: int = 8) -> DataFrame:
    """probe, pids and event_ids of the chain from the oldest known ancestor to each probe's process, all as last seen at the probe's
    time within the lookback. probes: (probe, host_id, pid, observed_at).

    The chain stops after `depth` parents, at a parent that isn't known or at one that is on it; a process that isn't known has
    no row. Pids may be reused: each is the process that it was at that time.
    """
    states = kept(procs.select("host_id", "pid", "observed_at", "event_id", "parent_pid"), "processes")
    start = F.struct(F.array().cast("array<bigint>").alias("pids"), F.array().cast("array<bigint>").alias("ids"))
    growing = probes.where("pid <> 0").select("probe", "host_id", "pid", "observed_at", start.alias("chain"))
    done = None
    for k in range(depth + 1):
        found = as_of(growing, states, ["host_id", "pid"], ["event_id", "parent_pid"], lookback_s, probe_id="probe")
        step = growing.join(found.select("probe", F.col("actor_event_id").alias("_id"), F.col("actor_parent_pid").alias("_up")), "probe")
        known = F.col("_id").isNotNull()
        chain = F.when(known, F.struct(F.concat(F.array("pid"), "chain.pids").alias("pids"), F.concat(F.array("_id"), "chain.ids").alias("ids"))).otherwise(F.col("chain"))
        grows = known & (F.coalesce("_up", F.lit(0)) != 0) & ~F.array_contains(chain["pids"], F.coalesce("_up", F.lit(0)))
        step = kept(step.select("probe", "host_id", F.col("_up").alias("pid"), "observed_at", chain.alias("chain"), grows.alias("_grows")), "chains")
        ended = step.where("not _grows" if k < depth else "true").select("probe", "chain")
        done = ended if done is None else done.unionByName(ended)
        growing = step.where("_grows").drop("_grows")
        if k == depth or growing.isEmpty():
            break
    return done.where(F.size("chain.pids") > 0).select("probe", F.col("chain.pids").alias("pids"), F.col("chain.ids").alias("event_ids"))


#: Columns of a process that `_children` finds below a parent.
FOUND = {"_pid": "bigint", "_at": "bigint", "_id": None, "_rank": "int"}


def _by_parent(procs: DataFrame, width: int) -> DataFrame:
    """Processes by parent and time bucket: each in its own bucket and the one before, so that a bucket has all rows of the windows,
    up to `width` microseconds wide, that begin in it."""
    us = micros(F.col("observed_at"))
    own = F.floor(us / width)
    return procs.where("parent_pid <> 0 and host_id is not null and observed_at is not null").select(
        "host_id", F.col("parent_pid").alias("pid"), F.col("pid").alias("_pid"), us.alias("_at"), F.col("event_id").alias("_id"), F.explode(F.array(own - 1, own)).alias("_bucket")
    )


def _first_of_each(width: int, cap: int, passed: list[str]):
    """Reads (host, pid, bucket) in falling order of time, rows before windows that begin with them, and keeps the first row of each of
    the `cap` earliest pids from there on; each window gives those within its width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, []
        for batch in batches:
            taken, found = [], []
            names = ["host_id", "pid", "_bucket", "_wanted", "_at", "_pid", "_id"]
            for k, (host, pid, bucket, wanted, at, child, event) in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                if (host, pid, bucket) != group:
                    group, first = (host, pid, bucket), []
                if not wanted:
                    first = [(child, at, event), *[x for x in first if x[0] != child][: cap - 1]]
                    continue
                for rank, x in enumerate(first, 1):
                    if x[1] > at + width:
                        break
                    taken.append(k)
                    found.append((*x, rank))
            kept_rows = batch.select(passed).take(pa.array(taken, pa.int64()))
            own = zip(*found, strict=True) if found else [[]] * len(FOUND)
            kinds = [*[batch.schema.field(n).type for n in ("_pid", "_at", "_id")], pa.int32()]
            yield pa.RecordBatch.from_arrays([*kept_rows.columns, *[pa.array(list(v), kind) for v, kind in zip(own, kinds, strict=True)]], names=[*passed, *FOUND])

    return run


def _children(wanted: DataFrame, by_parent: DataFrame, width: int, cap: int) -> DataFrame:
    """Children of each row of `wanted` (host_id, pid, _before and more, none named as in FOUND) in [_before - width, _before]: its columns
    with _pid, _at and _id of the earliest row of each pid, and _rank by time and pid, at most `cap`.

    Rows and windows of a parent meet in one pass in order of time, which holds `cap` children: they are not joined, so no row is
    handed on for each window that it is in.
    """
    kinds = {k: v or by_parent.schema["_id"].dataType.simpleString() for k, v in FOUND.items()}
    begin = F.col("_before") - width
    windows = wanted.where("host_id is not null and pid is not null and _before is not null").withColumns(
        {"_bucket": F.floor(begin / width), "_wanted": F.lit(True), "_at": begin, **{c: F.lit(None).cast(kinds[c]) for c in ("_pid", "_id")}}
    )
    both = windows.unionByName(by_parent.withColumn("_wanted", F.lit(False)), allowMissingColumns=True)
    key = ["host_id", "pid", "_bucket"]
    # of one time, the row of the least pid and id comes last before the windows
    order = [*key, F.desc("_at"), "_wanted", F.desc("_pid"), F.desc("_id")]
    out = StructType([*wanted.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in kinds.items())).fields])
    out = StructType([StructField(f.name, f.dataType) for f in out.fields])
    dealt = both.repartition(*key).sortWithinPartitions(*order)
    return dealt.mapInArrow(_first_of_each(width, cap, wanted.columns), out)


def children_at(procs: DataFrame, probes: DataFrame, lookback_s: int = 86_400, cap: int = 64) -> DataFrame:
    """probe, host_id, parent_pid, pid, event_id, rank: the children of each probe's process seen in the lookback before its time, by their
    earliest row under that parent, at most `cap`. probes: (probe, host_id, pid, observed_at). Pid 0 has none.

    The parent is looked at before rows of a pid are put together, so a reused pid is a child of each of its parents.
    """
    width = lookback_s * 1_000_000
    wanted = probes.select("probe", "host_id", "pid", micros(F.col("observed_at")).alias("_before"))
    found = _children(wanted, _by_parent(procs, width), width, cap)
    return found.select("probe", "host_id", F.col("pid").alias("parent_pid"), F.col("_pid").alias("pid"), F.col("_id").alias("event_id"), F.col("_rank").alias("rank"))


def process_tree_at(procs: DataFrame, probes: DataFrame, lookback_s: int = 86_400, depth: int = 4, fanout: int = 64, cap: int = 256) -> tuple[DataFrame, DataFrame]:
    """Trees below many processes as of their time: nodes (probe, host_id, event_id, parent_event_id, pid, parent, depth, place, is_root,
    has_more_children) and the status of each probe (probe, n_nodes, truncated, not_found).

    The root is the process as last seen at the probe's time within the lookback; children are those of the same window. Breadth
    first, by time and pid; a process on its own path isn't entered again; a tree keeps its first `cap` nodes; depth is 8 at most.
    """
    width = lookback_s * 1_000_000
    by_parent = kept(_by_parent(procs, width), "by-parent")
    roots = as_of(probes.where("pid <> 0"), procs, ["host_id", "pid"], ["event_id"], lookback_s, probe_id="probe").where("actor_event_id is not null")
    times = probes.select("probe", micros(F.col("observed_at")).alias("_before"))
    none = F.lit(None).cast("bigint")
    level = roots.join(times, "probe").select(
        "probe", "host_id", F.col("actor_event_id").alias("event_id"), none.alias("parent_event_id"), "pid", none.alias("parent"), F.lit(0).alias("depth"), F.lit("").alias("_key"), F.array("pid").alias("_path"), "_before"
    )
    level = kept(level, "roots")
    out, more = level, None
    for k in range(1, min(depth, 8) + 1):
        wanted = level.select("probe", "host_id", F.col("event_id").alias("_above"), "pid", "_key", "_path", "_before")
        below = kept(_children(wanted, by_parent, width, fanout + 1), "below")
        over = below.where(F.col("_rank") > fanout).select("probe", "_key", F.lit(True).alias("_more"))
        more = over if more is None else more.unionByName(over)
        level = below.where((F.col("_rank") <= fanout) & ~F.array_contains("_path", F.col("_pid"))).select(
            "probe", "host_id", F.col("_id").alias("event_id"), F.col("_above").alias("parent_event_id"), F.col("_pid").alias("pid"), F.col("pid").alias("parent"), F.lit(k).alias("depth"),
            F.concat("_key", F.lpad(F.col("_rank").cast("string"), 4, "0")).alias("_key"), F.concat("_path", F.array("_pid")).alias("_path"), "_before",
        )
        if level.isEmpty():
            break
        out = out.unionByName(level)
    place = F.row_number().over(Window.partitionBy("probe").orderBy("depth", "_key"))
    nodes = out.withColumn("place", place).where(F.col("place") <= cap).join(more, ["probe", "_key"], "left").select(
        "probe", "host_id", "event_id", "parent_event_id", "pid", "parent", "depth", "place", (F.col("depth") == 0).alias("is_root"), F.coalesce("_more", F.lit(False)).alias("has_more_children")
    )
    n = F.coalesce("_n", F.lit(0))
    sizes = out.groupBy("probe").agg(F.count(F.lit(1)).alias("_n"))
    status = probes.select("probe").join(sizes, "probe", "left").select("probe", F.least(n, F.lit(cap)).alias("n_nodes"), F.greatest(n - cap, F.lit(0)).alias("truncated"), F.col("_n").isNull().alias("not_found"))
    return nodes, status
