"""Process graph: as-of lookups, children, ancestors and process trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.operators.correlate import micros
from sentrylake.sources.store import kept


def as_of(probes: DataFrame, states: DataFrame, keys: list[str], values: list[str], lookback_s: int, probe_id: str = "event_id", ts: str = "observed_at") -> DataFrame:
    """The latest state of each probe's key in [t - lookback, t], by one union and a window instead of a range join.

    Time is cut into buckets of the lookback's width. A state goes to its own bucket and the next, a probe to its own, so
    a key that is never silent is still spread over time.
    """
    width = lookback_s * 1_000_000
    packed = F.struct(F.col(ts).alias("_at"), *values)
    bucket = F.floor(F.col("_us") / width)
    looked = probes.select(*keys, micros(F.col(ts)).alias("_us"), F.col(probe_id).alias("_probe"), F.lit(1).alias("_tag"), F.lit(None).cast(states.select(packed.alias("s")).schema["s"].dataType).alias("_state"))
    held = states.select(*keys, micros(F.col(ts)).alias("_us"), F.lit(None).cast(probes.schema[probe_id].dataType).alias("_probe"), F.lit(0).alias("_tag"), packed.alias("_state"))
    both = looked.withColumn("_bucket", bucket).unionByName(held.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_us", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_state", ignorenulls=True).over(w)).where("_tag = 1")
    fresh = F.when(F.col("_us") - micros(F.col("_last._at")) <= width, F.col("_last"))
    return seen.withColumn("_last", fresh).select(F.col("_probe").alias(probe_id), *keys, *[F.col(f"_last.{v}").alias(f"actor_{v}") for v in values])


def first_seen(procs: DataFrame) -> DataFrame:
    """One row per (host, pid) with the earliest values."""
    first = F.struct("observed_at", "event_id")
    return procs.groupBy("host_id", "pid").agg(F.min_by("parent_pid", first).alias("parent_pid"), F.min_by("exec_path", first).alias("exec_path"), F.min("observed_at").alias("observed_at"))


def children(procs: DataFrame, cap: int = 64) -> DataFrame:
    """Children of each (host, parent) by first appearance under that parent, at most `cap` a parent; a reused pid is a child of each
    of its parents. `lineage.children_at` looks at a window of time."""
    w = Window.partitionBy("host_id", "parent_pid").orderBy("observed_at", "pid")
    first = F.struct("observed_at", "event_id")
    below = procs.groupBy("host_id", "parent_pid", "pid").agg(F.min_by("exec_path", first).alias("exec_path"), F.min("observed_at").alias("observed_at"))
    return below.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def ancestors(procs: DataFrame, depth: int = 8) -> DataFrame:
    """Chain of pids from each process up to its oldest known ancestor; stops at a missing parent or a cycle.

    The table of processes is worked out once, and each level joins only the chains that still grow.
    """
    known = kept(first_seen(procs).select("host_id", "pid", "parent_pid"), "processes")
    up = known.select("host_id", F.col("pid").alias("_next"), F.col("parent_pid").alias("_above"))
    growing = known.select("host_id", "pid", F.array("pid").alias("chain"), F.col("parent_pid").alias("_next"))
    done = None
    for k in range(depth):
        joined = growing.join(up, ["host_id", "_next"], "left") if k else growing.withColumn("_above", F.col("_next"))
        if k:
            grows = F.col("_above").isNotNull() & ~F.array_contains("chain", F.col("_next"))
            joined = kept(joined.select("host_id", "pid", F.when(grows, F.concat("chain", F.array("_next"))).otherwise(F.col("chain")).alias("chain"), grows.alias("_grew"), "_above"), "chains")
            ended = joined.where("not _grew").select("host_id", "pid", "chain")
            done = ended if done is None else done.unionByName(ended)
            growing = joined.where("_grew").select("host_id", "pid", "chain", F.col("_above").alias("_next"))
            if growing.isEmpty():
                break
    rest = growing.select("host_id", "pid", "chain")
    done = rest if done is None else done.unionByName(rest)
    return done.select("host_id", "pid", F.reverse("chain").alias("chain"))


def _levels(procs: DataFrame, roots: DataFrame, depth: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """All nodes of the trees, and the processes with more children than `fanout`; both worked out once."""
    known = kept(procs.groupBy("host_id", "pid", "parent_pid").agg(F.min("observed_at").alias("observed_at")), "processes")
    every = Window.partitionBy("host_id", "parent_pid")
    ranked = known.withColumn("_rank", F.row_number().over(every.orderBy("observed_at", "pid")))
    taken = ranked.where(F.col("_rank") <= fanout + 1)
    below = kept(taken.select("host_id", F.col("parent_pid").alias("pid"), F.col("pid").alias("_pid"), F.lpad(F.col("_rank").cast("string"), 4, "0").alias("_r"), (F.col("_rank") > fanout).alias("_over")), "children")
    more = below.where("_over").select("host_id", "pid", F.lit(True).alias("_more"))
    level = roots.distinct().join(known.select("host_id", F.col("pid").alias("root")).distinct(), ["host_id", "root"]).select(
        "host_id", "root", F.col("root").alias("pid"), F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth"), F.lit("").alias("_key"), F.array("root").alias("_path")
    )
    out = level
    for k in range(1, min(depth, 8) + 1):
        level = level.join(below.where("not _over"), ["host_id", "pid"]).where(~F.array_contains("_path", F.col("_pid"))).select(
            "host_id", "root", F.col("_pid").alias("pid"), F.col("pid").alias("parent"), F.lit(k).alias("depth"), F.concat("_key", "_r").alias("_key"), F.concat("_path", F.array("_pid")).alias("_path")
        )
        level = kept(level, "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out, more


def process_tree(procs: DataFrame, roots: DataFrame, depth: int = 4, fanout: int = 64, cap: int = 256) -> DataFrame:
    """Trees below many roots (host_id, root) at once, a join a level (8 at most): host_id, root, pid, parent, depth,
    place (breadth first, by time and pid), is_root, has_more_children. Unknown roots have no rows; a process that is
    on its own path is not entered again, and a tree keeps its first `cap` nodes.
    """
    out, more = _levels(procs, roots, depth, fanout)
    w = Window.partitionBy("host_id", "root").orderBy("depth", "_key")
    placed = out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    return placed.join(more, ["host_id", "pid"], "left").select(
        "host_id", "root", "pid", "parent", "depth", "place", (F.col("depth") == 0).alias("is_root"), F.coalesce("_more", F.lit(False)).alias("has_more_children")
    )


def tree_status(procs: DataFrame, roots: DataFrame, depth: int = 4, fanout: int = 64, cap: int = 256) -> DataFrame:
    """host_id, root, n_nodes that the tree keeps, truncated (how many `cap` cuts off) and not_found, of every root asked for."""
    out, _ = _levels(procs, roots, depth, fanout)
    sizes = out.groupBy("host_id", "root").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    joined = roots.distinct().join(sizes, ["host_id", "root"], "left")
    return joined.select("host_id", "root", F.least(n, F.lit(cap)).alias("n_nodes"), F.greatest(n - cap, F.lit(0)).alias("truncated"), F.col("_n").isNull().alias("not_found"))


# The words of labels and the shapes, by class.
def node_label(class_uid: Column) -> Column:
    """A node's label by class; paths are cut to 64."""
    cut = lambda c: F.when(F.length(c) > 64, F.concat(F.substring(c, 1, 63), F.lit("…"))).otherwise(F.coalesce(F.col(c), F.lit("")))
    pid = F.concat(F.lit("proc pid="), F.col("pid").cast("string"), F.lit("\\n"))
    ends = [F.concat(F.col(f"{side}_ip"), F.lit(":"), F.col(f"{side}_port").cast("string")) for side in ("src", "dst")]
    return (
        F.when(class_uid == 1007, F.concat(pid, cut("exec_path")))
        .when(class_uid == 1001, F.concat(F.lit("file\\n"), cut("file_path")))
        .when(class_uid == 4001, F.concat(F.lit("net "), F.col("protocol"), F.lit("\\n"), ends[0], F.lit(" -> "), ends[1]))
        .when(class_uid == 2004, F.concat(F.lit("alert\\n"), F.col("rule_uid")))
        .otherwise(F.concat(F.lit("event N/A\\n"), F.col("event_id").cast("string")))
    )


def node_shape(class_uid: Column) -> Column:
    return F.when(class_uid == 1007, "rectangle").when(class_uid == 1001, "page").when(class_uid == 4001, "cylinder").when(class_uid == 2004, "diamond").otherwise("circle")


def flow_edges(members: DataFrame, events: DataFrame, lookback_s: int = 3600, cap: int = 32) -> DataFrame:
    """Edges (alert_id, actor_id, event_id) from the process behind each of an alert's events to the event.

    members: (alert_id, event_id), of which an alert's first `cap` by id as text are taken. The actor of a process is
    its parent, that of a file or network event its own pid, as last seen within the lookback. No self or double edges.
    """
    first = Window.partitionBy("alert_id").orderBy(F.col("event_id").cast("string"))
    taken = members.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap).drop("_n")
    behind = F.when(F.col("class_uid") == 1007, F.col("parent_pid")).when(F.col("class_uid").isin(1001, 4001), F.col("pid"))
    wanted = events.join(taken.select("event_id").distinct(), "event_id", "left_semi").withColumn("_actor", behind).where("_actor > 0")
    states = events.where("class_uid = 1007").withColumn("_id", F.col("event_id"))
    probes = wanted.select("event_id", "host_id", F.col("_actor").alias("pid"), "observed_at")
    found = as_of(probes, states.select("host_id", "pid", "observed_at", "_id"), ["host_id", "pid"], ["_id"], lookback_s)
    actors = found.where(F.col("actor__id").isNotNull() & (F.col("actor__id") != F.col("event_id"))).select("event_id", F.col("actor__id").alias("actor_id"))
    return taken.join(actors, "event_id").select("alert_id", "actor_id", "event_id")


def flow_nodes(members: DataFrame, events: DataFrame, cap: int = 32) -> DataFrame:
    """(alert_id, event_id, label, shape, found) of an alert's first `cap` events by id as text; one that no table has gets a sentinel."""
    first = Window.partitionBy("alert_id").orderBy(F.col("event_id").cast("string"))
    taken = members.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap).drop("_n")
    joined = taken.join(events, "event_id", "left")
    return joined.select("alert_id", "event_id", node_label(F.col("class_uid")).alias("label"), node_shape(F.col("class_uid")).alias("shape"), F.col("class_uid").isNotNull().alias("found"))


def graph_key(alert_id: Column, event_ids: Column) -> Column:
    """A key of an alert's graph that does not depend on the order of its event ids."""
    ids = F.sort_array(F.transform(event_ids, lambda x: x.cast("string")))
    return F.sha2(F.concat(alert_id, F.lit("|"), F.array_join(ids, ",")), 256)
