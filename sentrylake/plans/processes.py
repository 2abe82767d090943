"""Queries of processes in time, over a fixture in which pids are reused, parents change and processes exit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.operators import graph, lineage
from sentrylake.plans.catalog import DAY, register

WEEK, GRACE = 7 * DAY, 2 * DAY
FIELDS = ["exec_path", "cmdline", "parent_pid"]


def reused(t: DataFrame) -> DataFrame:
    """Thirty pids a host, the parent of each changing by the week; one event in four is an exit, one in three has no path."""
    pid = 1 + F.col("pid") % 30
    week = F.floor(F.unix_date(F.to_date("observed_at")) / 7)
    path = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("exec_path"))
    return t.select("event_id", "host_id", "class_uid", "observed_at", "cmdline", path.alias("exec_path"), pid.alias("pid"), (F.floor(pid / 3) + week % 2).cast("bigint").alias("parent_pid"), (F.col("event_id") % 4 == 0).alias("is_exit"))


REUSED = """u AS (SELECT event_id, host_id, class_uid, observed_at, epoch_us(observed_at) AS us, cmdline, CASE WHEN event_id % 3 = 0 THEN '' ELSE exec_path END AS exec_path, 1 + pid % 30 AS pid,
  (1 + pid % 30) // 3 + ((CAST(observed_at AS DATE) - DATE '1970-01-01') // 7) % 2 AS parent_pid, event_id % 4 = 0 AS is_exit FROM t),
s AS (SELECT * FROM u WHERE class_uid = 1007), q AS (SELECT event_id AS probe, host_id, pid, observed_at, us FROM u WHERE class_uid = 2004)"""


def procs(t: DataFrame) -> DataFrame:
    return reused(t).where("class_uid = 1007")


def probes(t: DataFrame) -> DataFrame:
    return reused(t).where("class_uid = 2004").select(F.col("event_id").alias("probe"), "host_id", "pid", "observed_at")


EDGES = f"""{REUSED}, e0 AS (SELECT q.probe, q.host_id, s.parent_pid AS parent, s.pid, arg_min(s.event_id, (s.us, s.event_id)) AS event_id, min(s.us) AS us FROM q JOIN s ON s.host_id = q.host_id AND s.us BETWEEN q.us - {WEEK}000000 AND q.us
  WHERE s.parent_pid <> 0 GROUP BY ALL), e AS (SELECT *, CAST(row_number() OVER (PARTITION BY probe, parent ORDER BY us, pid) AS INT) AS rank FROM e0)"""
register(
    "g2_children_at", lambda t: lineage.children_at(procs(t), probes(t), WEEK, 2),
    f"WITH {EDGES} SELECT e.probe, e.host_id, e.parent AS parent_pid, e.pid, e.event_id, e.rank FROM e JOIN q ON q.probe = e.probe AND q.pid = e.parent WHERE rank <= 2",
)
register(
    "g2_children_reused", lambda t: graph.children(procs(t)).select("host_id", "parent_pid", "pid", "rank"),
    f"""WITH {REUSED}, f AS (SELECT host_id, parent_pid, pid, min(us) AS us FROM s GROUP BY 1, 2, 3)
SELECT host_id, parent_pid, pid, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY host_id, parent_pid ORDER BY us, pid) AS INT) AS rank FROM f) WHERE rank <= 64""",
)


def climb(steps: int) -> str:
    """c<steps>: chains climbed by as many as-of lookups."""
    out = ["c0 AS (SELECT probe, host_id, us, observed_at, pid AS next, []::BIGINT[] AS pids, []::BIGINT[] AS ids FROM q)"]
    for k in range(steps):
        known = f"s.event_id IS NOT NULL AND c.us - s.us <= {WEEK}000000"
        out.append(f"""c{k + 1} AS (SELECT c.probe, c.host_id, c.us, c.observed_at, CASE WHEN {known} AND s.parent_pid <> 0 AND NOT list_contains(list_prepend(next, pids), s.parent_pid) THEN s.parent_pid END AS next,
  CASE WHEN {known} THEN list_prepend(next, pids) ELSE pids END AS pids, CASE WHEN {known} THEN list_prepend(s.event_id, ids) ELSE ids END AS ids
  FROM c{k} c ASOF LEFT JOIN s ON s.host_id = c.host_id AND s.pid = c.next AND c.observed_at >= s.observed_at)""")
    return ",\n".join(out)


register("g3_ancestors_at", lambda t: lineage.ancestors_at(procs(t), probes(t), WEEK, 3), f"WITH {REUSED}, {climb(4)} SELECT probe, pids, ids AS event_ids FROM c4 WHERE len(pids) > 0")
TREE = f"""{EDGES}, a AS (SELECT q.probe, q.host_id, q.pid, s.event_id, q.us - s.us AS age FROM q ASOF JOIN s ON s.host_id = q.host_id AND s.pid = q.pid AND q.observed_at >= s.observed_at),
r AS (SELECT probe, host_id, event_id, NULL::BIGINT AS parent_event_id, pid, NULL::BIGINT AS parent, 0 AS depth, '' AS k, [pid] AS path FROM a WHERE age <= {WEEK}000000
  UNION ALL SELECT r.probe, r.host_id, e.event_id, r.event_id, e.pid, r.pid, r.depth + 1, r.k || lpad(e.rank::VARCHAR, 4, '0'), list_append(r.path, e.pid)
  FROM r JOIN e ON e.probe = r.probe AND e.parent = r.pid WHERE e.rank <= 2 AND r.depth < 3 AND NOT list_contains(r.path, e.pid))"""
register(
    "g4_tree_at", lambda t: lineage.process_tree_at(procs(t), probes(t), WEEK, 3, 2, 6)[0],
    f"""WITH {TREE}, m AS (SELECT probe, parent AS pid, max(rank) > 2 AS more FROM e GROUP BY 1, 2)
SELECT r.probe, host_id, event_id, parent_event_id, r.pid, parent, depth, CAST(row_number() OVER (PARTITION BY r.probe ORDER BY depth, k) AS INT) AS place, depth = 0 AS is_root, depth < 3 AND coalesce(more, false) AS has_more_children
FROM r LEFT JOIN m ON m.probe = r.probe AND m.pid = r.pid QUALIFY place <= 6""",
)
register(
    "g5_tree_status_at", lambda t: lineage.process_tree_at(procs(t), probes(t), WEEK, 3, 2, 3)[1],
    f"""WITH {TREE}, n AS (SELECT probe, count(*) AS n FROM r GROUP BY 1)
SELECT q.probe, least(coalesce(n, 0), 3) AS n_nodes, greatest(coalesce(n, 0) - 3, 0) AS truncated, n IS NULL AS not_found FROM q LEFT JOIN n ON n.probe = q.probe""",
)


def states(t: DataFrame) -> DataFrame:
    return lineage.live_states(procs(t), FIELDS, F.col("is_exit"), grace_s=GRACE)


LIVE = f"""{REUSED}, g0 AS (SELECT *, lag(is_exit) OVER w AS was, lag(us) OVER w AS prior, lead(us) OVER w AS after FROM s WINDOW w AS (PARTITION BY host_id, pid ORDER BY us, event_id)),
g AS (SELECT *, count(*) FILTER (WHERE was IS NULL OR (was AND us - prior > {GRACE}000000)) OVER (PARTITION BY host_id, pid ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS gen FROM g0),
l AS (SELECT event_id, host_id, pid, observed_at, us, is_exit, last_value(nullif(exec_path, '') IGNORE NULLS) OVER w AS exec_path, last_value(nullif(cmdline, '') IGNORE NULLS) OVER w AS cmdline,
  last_value(nullif(parent_pid, 0) IGNORE NULLS) OVER w AS parent_pid, first_value(observed_at) OVER w AS created_at, us AS start_us,
  CASE WHEN is_exit THEN least(coalesce(after, us + {GRACE}000000), us + {GRACE}000000) ELSE after END AS end_us FROM g WINDOW w AS (PARTITION BY host_id, pid, gen ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))"""
register(
    "b5_live_states", lambda t: states(t).drop("observed_at", "is_exit"),
    f"WITH {LIVE} SELECT host_id, pid, event_id, exec_path, cmdline, parent_pid, created_at, start_us, end_us FROM l",
)
register(
    "b6_actor_live", lambda t: lineage.join_actor_live(reused(t).where("class_uid IN (1001, 4001)"), states(t), ["exec_path", "cmdline"], grace_s=GRACE),
    f"""WITH {LIVE}, p AS (SELECT * FROM u WHERE class_uid IN (1001, 4001)), j AS (SELECT p.event_id, p.pid, l.event_id IS NOT NULL AND (NOT l.is_exit OR p.us - l.us <= {GRACE}000000) AS known, l.exec_path, l.cmdline
  FROM p ASOF LEFT JOIN l ON l.host_id = p.host_id AND l.pid = p.pid AND p.observed_at >= l.observed_at)
SELECT event_id, pid AS actor_pid, known, CASE WHEN known THEN exec_path END AS actor_exec_path, CASE WHEN known THEN cmdline END AS actor_cmdline FROM j""",
)


def chain(steps: int) -> str:
    out = ["d0 AS (SELECT event_id, host_id, us, observed_at, nullif(parent_pid, 0) AS next, []::STRUCT(pid BIGINT, exec_path VARCHAR)[] AS parents FROM s)"]
    for k in range(steps):
        known = f"l.event_id IS NOT NULL AND (NOT l.is_exit OR d.us - l.us <= {GRACE}000000)"
        out.append(f"""d{k + 1} AS (SELECT d.event_id, d.host_id, d.us, d.observed_at, CASE WHEN {known} THEN l.parent_pid END AS next,
  CASE WHEN d.next IS NULL THEN parents ELSE list_append(parents, {{'pid': d.next, 'exec_path': CASE WHEN {known} THEN l.exec_path END}}) END AS parents
  FROM d{k} d ASOF LEFT JOIN l ON l.host_id = d.host_id AND l.pid = d.next AND d.observed_at >= l.observed_at)""")
    return ",\n".join(out)


register(
    "b7_chain_live", lambda t: lineage.parent_chain_live(procs(t), states(t), 4, grace_s=GRACE).select("event_id", F.transform("parents", lambda p: F.concat_ws(" ", p["pid"].cast("string"), p["exec_path"])).alias("parents")),
    f"WITH {LIVE}, {chain(4)} SELECT event_id, [concat_ws(' ', p.pid, p.exec_path) FOR p IN parents] AS parents FROM d4",
)
