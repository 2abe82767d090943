"""Processes in time, frames with repeated ids, and retention by partitions, against plain Python on small rows."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from sentrylake.operators import carry, correlate, lineage
from sentrylake.sources import decode, store

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, host_id string, pid long, parent_pid long, observed_at timestamp, exec_path string, is_exit boolean"


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def rows(*events) -> list[tuple]:
    """(second, pid, parent, path, is_exit) as events of one host."""
    return [(k, "h", pid, parent, at(s), path, gone) for k, (s, pid, parent, path, gone) in enumerate(events)]


def test_states_of_a_reused_pid(spark):
    """An exit ends a state after its grace; an event within it revives the process, one after it begins a new one."""
    df = spark.createDataFrame(rows((0, 5, 1, "/a", False), (10, 5, 0, "", True), (35, 5, 0, "", False), (40, 5, 2, "", True), (200, 5, 3, "", False), (90_000, 5, 0, "/b", False)), EVENTS)
    got = {r.event_id: r for r in lineage.live_states(df, ["exec_path", "parent_pid"], F.col("is_exit")).collect()}
    t0 = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    shown = {k: (r.exec_path, r.parent_pid, r.created_at, (r.end_us - t0) / 1e6 if r.end_us else None) for k, r in got.items()}
    assert shown == {
        0: ("/a", 1, at(0), 10), 1: ("/a", 1, at(0), 35), 2: ("/a", 1, at(0), 40), 3: ("/a", 2, at(0), 70),
        4: (None, 3, at(200), 90_000), 5: ("/b", 3, at(200), None),
    }


def test_actor_and_chain_as_they_live(spark):
    procs = rows((0, 1, 0, "/init", False), (5, 2, 1, "/sh", False), (6, 3, 2, "/old", False), (20, 3, 0, "", True), (100, 3, 1, "/new", False), (101, 4, 3, "/x", False), (102, 6, 9, "/y", False))
    df = spark.createDataFrame(procs, EVENTS)
    states = lineage.live_states(df, ["exec_path", "parent_pid"], F.col("is_exit"))
    files = spark.createDataFrame([(100 + k, "h", pid, 0, at(s), "", False) for k, (s, pid) in enumerate([(10, 3), (45, 3), (60, 3), (100, 3), (3, 3), (400_000, 2), (7, 77)])], EVENTS)
    got = {r.event_id: (r.actor_pid, r.known, r.actor_exec_path) for r in lineage.join_actor_live(files, states, ["exec_path"]).collect()}
    assert got == {100: (3, True, "/old"), 101: (3, True, "/old"), 102: (3, False, None), 103: (3, True, "/new"), 104: (3, False, None), 105: (2, True, "/sh"), 106: (77, False, None)}
    chains = {r.event_id: [(p.pid, p.exec_path) for p in r.parents] for r in lineage.parent_chain_live(df, states).collect()}
    assert chains[5] == [(3, "/new"), (1, "/init")] and chains[2] == [(2, "/sh"), (1, "/init")] and chains[6] == [(9, None)] and chains[0] == []
    assert {r.event_id: len(r.parents) for r in lineage.parent_chain_live(df, states, depth=1).collect()}[2] == 1


def test_children_ancestors_and_trees_of_a_window(spark):
    """Pid 3 is a child of 1 and later of 2; what is outside the window, or after the probe, isn't seen."""
    procs = rows((0, 1, 0, "/i", False), (1, 2, 1, "/s", False), (2, 3, 1, "/a", False), (50, 3, 2, "/b", False), (51, 4, 3, "/c", False), (52, 5, 3, "/d", False), (53, 1, 5, "/loop", False), (300, 6, 1, "/late", False))
    df = spark.createDataFrame(procs, EVENTS)
    probes = spark.createDataFrame([(1, "h", 1, at(60)), (2, "h", 2, at(60)), (3, "h", 1, at(1.5)), (4, "h", 3, at(120)), (5, "h", 4, at(60)), (6, "h", 99, at(60)), (7, "h", 0, at(60))], "probe long, host_id string, pid long, observed_at timestamp")
    kids = {}
    for r in lineage.children_at(df, probes, 100).orderBy("probe", "rank").collect():
        kids.setdefault(r.probe, []).append((r.pid, r.event_id))
    assert kids == {1: [(2, 1), (3, 2)], 2: [(3, 3)], 3: [(2, 1)], 4: [(4, 4), (5, 5)]}
    chains = {r.probe: r.pids for r in lineage.ancestors_at(df, probes, 100).collect()}
    assert chains == {1: [2, 3, 5, 1], 2: [3, 5, 1, 2], 3: [1], 4: [3], 5: [5, 1, 2, 3, 4]}
    nodes, status = lineage.process_tree_at(df, probes, 100, depth=2, fanout=1, cap=2)
    tree = {}
    for r in nodes.orderBy("probe", "place").collect():
        tree.setdefault(r.probe, []).append((r.pid, r.parent, r.depth, r.has_more_children))
    assert tree[1] == [(1, None, 0, True), (2, 1, 1, False)] and tree[4] == [(3, None, 0, True), (4, 3, 1, False)] and tree[3] == [(1, None, 0, False), (2, 1, 1, False)]
    told = {r.probe: (r.n_nodes, r.truncated, r.not_found) for r in status.collect()}
    assert told[1] == (2, 1, False) and told[6] == (0, 0, True) and told[7] == (0, 0, True)


def test_carried_over_buckets(spark):
    """Last values across buckets equal one plain pass, null keys and null values among them."""
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.randrange(-500, 500), k, rng.choice([None, None, k])) for k in range(400)]
    df = spark.createDataFrame(data, "k string, _us long, id long, v long")
    for inclusive in (True, False):
        got = {r.id: r.last for r in carry.carried(df, ["k"], ["_us", "id"], {"last": F.col("v")}, inclusive, bucket_us=37).collect()}
        last, want = {}, {}
        for k, us, i, v in sorted(data, key=lambda r: (r[1], r[2])):
            before = last.get(k)
            last[k] = before if v is None else v
            want[i] = last[k] if inclusive else before
        assert got == want
    after = {r.id: r.nxt for r in carry.followed(df, ["k"], "id", "nxt", bucket_us=37).collect()}
    ordered = sorted(data, key=lambda r: (r[1], r[2]))
    assert after == {i: next((u for k2, u, j, _ in ordered if k2 == k and (u, j) > (us, i)), None) for k, us, i, _ in data}


def test_frames_with_repeated_ids(spark):
    """One id on events of two users and times: each row lists its own frame."""
    df = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(5)), (2, "b", at(100)), (3, "b", at(104)), (2, "a", at(5))], "event_id long, user_name string, observed_at timestamp")
    got = sorted((r.k0, r.event_id, r.n_hits, tuple(r.event_ids)) for r in correlate.count_over(df, F.lit(True), ["user_name"], 10, ">", 1).collect())
    assert got == [("a", 2, 3, (1, 2, 2))] * 2 + [("b", 3, 2, (2, 3))]
    found = correlate.near(df, F.col("event_id") == 2, F.col("event_id") != 2, 10, ["user_name"])
    assert sorted((r.k0, r.event_id, tuple(r.event_ids)) for r in found.collect()) == [("a", 2, (2, 2, 1))] * 2 + [("b", 3, (2, 3))]


def test_retention_touches_expired_days_only(spark, tmp_path):
    events = spark.createDataFrame([(k, "h", at(86_400 * k)) for k in range(12)], "event_id long, host_id string, observed_at timestamp")
    path = str(tmp_path / "t")
    decode.write_events(events, path)
    before = {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    gone = store.drop_expired(spark, path, dt.datetime(2024, 1, 12), 7)
    assert gone == [dt.date(2024, 1, k) for k in (1, 2, 3, 4)]
    after = {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert after == {k: v for k, v in before.items() if not any(f"event_date={d}" in k for d in gone)} and len(after) < len(before)
    table = store.read_events(spark, path, events.schema)
    cut = store.apply_retention(table, F.lit("2024-01-12 00:00:00"), 3)
    assert sorted(r.event_id for r in cut.collect()) == [8, 9, 10, 11]
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.drop_expired(spark, path, dt.datetime(2024, 1, 12), 7) == []
