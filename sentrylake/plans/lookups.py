"""Queries of alerts, responses, search and graphs, each beside its DuckDB text."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.predicates import m
from sentrylake.operators import alerts, graph, responses, search
from sentrylake.plans.catalog import DAY, pick, register
from sentrylake.plans.intake import events
from sentrylake.sources import classes
from sentrylake.sources.store import kept


def bash() -> Column:
    return m("exec_path").endswith("/bash")


# E: alerts
STATES, STEPS = ["acknowledged", "in_progress", "closed", "new"], ["running", "done", "failed", "denied", "reverted"]
register(
    "e1_alert_candidates",
    lambda t: alerts.alerts_from_findings(
        t.where("class_uid = 2004").withColumns({"severity_id": F.col("severity_id") * 2, "title": F.concat(F.lit("found "), "rule_uid"), "host_id": F.when(F.col("pid") % 10 > 0, F.col("host_id")).otherwise("")}), title="title"
    ).select("event_id", "severity_id", "reason_code"),
    "SELECT event_id, CASE WHEN severity_id * 2 BETWEEN 1 AND 6 THEN severity_id * 2 ELSE 1 END AS severity_id, 'found ' || rule_uid AS reason_code FROM t WHERE class_uid = 2004 AND pid % 10 > 0",
)


def windows_of(t: DataFrame) -> DataFrame:
    """Windows: none, an hour, six hours or a day, by the rule's number."""
    window = F.element_at(F.array(F.lit(None).cast("int"), F.lit(3600), F.lit(21600), F.lit(DAY)), F.substring("rule_uid", -2, 2).cast("int") % 4 + 1)
    return t.select("rule_uid").distinct().withColumn("window_s", window)


FOLD = f"""WITH a AS (SELECT event_id, rule_uid, host_id, epoch_us(observed_at) AS us, [NULL, 3600, 21600, {DAY}][CAST(substr(rule_uid, -2) AS INT) % 4 + 1] AS w FROM t WHERE class_uid = 2004),
o AS (SELECT *, row_number() OVER (PARTITION BY rule_uid, host_id ORDER BY us, event_id) AS k FROM a),
f AS (SELECT event_id, rule_uid, host_id, us, w, k, true AS kept, us AS last FROM o WHERE k = 1
  UNION ALL SELECT o.event_id, o.rule_uid, o.host_id, o.us, o.w, o.k, o.w IS NULL OR f.last <= o.us - o.w * 1000000::BIGINT, CASE WHEN o.w IS NULL OR f.last <= o.us - o.w * 1000000::BIGINT THEN o.us ELSE f.last END
  FROM f JOIN o ON o.rule_uid = f.rule_uid AND o.host_id = f.host_id AND o.k = f.k + 1)"""
register(
    "e3_alert_outcomes", lambda t: alerts.alert_outcomes(alerts.dedupe_alerts(t.where("class_uid = 2004"), windows_of(t)), F.col("event_id") % 50 == 0),
    f"{FOLD} SELECT CASE WHEN event_id % 50 = 0 THEN 'errored' WHEN kept THEN 'inserted' ELSE 'deduped' END AS outcome, count(*) AS n FROM f GROUP BY 1",
)


def alert_table(t: DataFrame) -> DataFrame:
    owner = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("analyst"), (F.col("event_id") % 3).cast("string")))
    status = pick(["new", *STATES[:3]], "event_id")
    return t.where("class_uid = 2004").select(F.col("event_id").alias("id"), "rule_uid", "host_id", F.col("severity_id").alias("severity"), status.alias("status"), owner.alias("assigned_to"), F.col("observed_at").alias("created_at"))


def rule_names(t: DataFrame) -> DataFrame:
    return t.select("rule_uid").distinct().where("rule_uid <> 'rule-05'").withColumn("name", F.concat(F.lit("Rule "), "rule_uid"))


def host_table(t: DataFrame) -> DataFrame:
    """Hosts with a name that five share, their first event as enrolment, every sixth revoked; one is unknown."""
    n = F.substring("host_id", 6, 2).cast("int")
    each = t.where("host_id <> 'host-09'").groupBy("host_id").agg(F.min("observed_at").alias("enrolled_at"), F.max("observed_at").alias("last_seen"))
    return each.withColumns({"hostname": F.concat(F.lit("Box-"), (n % 4).cast("string")), "revoked_at": F.when(n % 6 == 5, F.col("last_seen")), "agent_version": F.lit("1.0")})


ALERTS = """al AS (SELECT event_id AS id, rule_uid, host_id, severity_id AS severity, ['new', 'acknowledged', 'in_progress', 'closed'][event_id % 4 + 1] AS status,
  CASE WHEN event_id % 3 > 0 THEN 'analyst' || event_id % 3 END AS assigned_to, observed_at AS created_at FROM t WHERE class_uid = 2004),
hs AS (SELECT host_id, min(observed_at) AS enrolled_at, max(observed_at) AS last_seen, 'Box-' || substr(host_id, 6, 2)::INT % 4 AS hostname, CASE WHEN substr(host_id, 6, 2)::INT % 6 = 5 THEN max(observed_at) END AS revoked_at
  FROM t WHERE host_id <> 'host-09' GROUP BY host_id),
nm AS (SELECT al.*, CASE WHEN rule_uid <> 'rule-05' THEN 'Rule ' || rule_uid ELSE '' END AS rule_name, coalesce(hostname, '') AS hostname FROM al LEFT JOIN hs USING (host_id))"""


def _alerts_listed(t: DataFrame) -> DataFrame:
    tables = (alert_table(t), rule_names(t), host_table(t))
    first = alerts.list_alerts(*tables, status=["new", "closed"], unassigned=True, since="2024-01-03 00:00:00", until="2024-01-28 00:00:00", n=40)
    second = alerts.list_alerts(*tables, assignee="analyst1", severity=3, before=("2024-01-20 00:00:00", 0), n=30)
    return first.withColumn("page", F.lit(1)).unionByName(second.withColumn("page", F.lit(2)))


register(
    "e4_list_alerts", _alerts_listed,
    f"""WITH {ALERTS} (SELECT *, 1 AS page FROM nm WHERE status IN ('new', 'closed') AND assigned_to IS NULL AND created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' ORDER BY created_at DESC, id DESC LIMIT 40)
UNION ALL (SELECT *, 2 FROM nm WHERE assigned_to = 'analyst1' AND severity = 3 AND (created_at, id) < (TIMESTAMP '2024-01-20', 0) ORDER BY created_at DESC, id DESC LIMIT 30)""",
)


def _one_alert(t: DataFrame) -> DataFrame:
    last = t.where("class_uid = 2004").agg(F.max("event_id").alias("wanted"))
    # the id comes from the table: one row
    mine = alert_table(t).join(F.broadcast(last), F.col("id") == F.col("wanted")).drop("wanted")
    return alerts.with_names(mine, rule_names(t), host_table(t)).unionByName(alerts.get_alert(alert_table(t), rule_names(t), host_table(t), -1))


register("e5_get_alert", _one_alert, f"WITH {ALERTS} SELECT * FROM nm WHERE id = (SELECT max(id) FROM al)")


def log_of(t: DataFrame, names: list[str]) -> DataFrame:
    """Transitions of each pid in order of their events, most of which the states refuse."""
    reason = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("because "), F.col("event_id").cast("string"))).otherwise("")
    return t.select(F.col("pid").alias("id"), F.col("event_id").alias("seq"), pick(names, "event_id").alias("to_status"), reason.alias("reason"), F.col("observed_at").alias("at"))


def steps_sql(names: list[str], start: str, moves: dict) -> str:
    """a: every transition with the state before it and whether it was taken."""
    pairs = ", ".join(f"'{a}>{b}'" for a, bs in moves.items() for b in bs)
    return f"""WITH l AS (SELECT pid AS id, event_id AS seq, observed_at AS seen_at, CASE WHEN event_id % 3 = 0 THEN 'because ' || event_id ELSE '' END AS reason, {names}[event_id % {len(names)} + 1] AS s,
  row_number() OVER (PARTITION BY pid ORDER BY event_id) AS k FROM t),
a AS (SELECT *, '{start}' AS before, '{start}>' || s IN ({pairs}) AS good, CASE WHEN '{start}>' || s IN ({pairs}) THEN s ELSE '{start}' END AS after FROM l WHERE k = 1
  UNION ALL SELECT l.*, a.after, a.after || '>' || l.s IN ({pairs}), CASE WHEN a.after || '>' || l.s IN ({pairs}) THEN l.s ELSE a.after END FROM a JOIN l ON l.id = a.id AND l.k = a.k + 1)"""


register(
    "e6_alert_lifecycle", lambda t: alerts.alert_states(log_of(t, STATES)),
    f"""{steps_sql(STATES, "new", alerts.ALERT_MOVES)} SELECT id, arg_max(after, k) AS status, count(*) FILTER (WHERE NOT good) AS refused,
coalesce(arg_max(reason, k) FILTER (WHERE good AND reason <> ''), '') AS reason_code, CASE WHEN arg_max(after, k) = 'closed' THEN arg_max(seen_at, k) FILTER (WHERE good) END AS closed_at FROM a GROUP BY id""",
)
register(
    "e7_audit_rows", lambda t: alerts.audit_rows(log_of(t, STATES)),
    f"""{steps_sql(STATES, "new", alerts.ALERT_MOVES)} SELECT seq, CASE WHEN before = 'closed' AND s = 'in_progress' THEN 'alert.reopened' ELSE 'alert.transition.' || before || '_' || s END AS action,
'alert' AS target_kind, id::VARCHAR AS target_id FROM a WHERE good""",
)
register(
    "e8_audit_by_target", lambda t: alerts.audit_by_target(alerts.audit_rows(log_of(t, STATES)), "alert", "42", 25),
    f"""{steps_sql(STATES, "new", alerts.ALERT_MOVES)} SELECT seq, CASE WHEN before = 'closed' AND s = 'in_progress' THEN 'alert.reopened' ELSE 'alert.transition.' || before || '_' || s END AS action,
'alert' AS target_kind, id::VARCHAR AS target_id FROM a WHERE good AND id = 42 ORDER BY seq DESC LIMIT 25""",
)
register(
    "e13_response_lifecycle", lambda t: alerts.response_states(log_of(t, STEPS).drop("reason")),
    f"""{steps_sql(STEPS, "pending", alerts.RESPONSE_MOVES)} SELECT id, arg_max(after, k) AS status, count(*) FILTER (WHERE NOT good) AS refused,
arg_min(seen_at, k) FILTER (WHERE good AND s = 'running') AS started_at, arg_max(seen_at, k) FILTER (WHERE good AND s IN ('done', 'failed', 'denied')) AS completed_at FROM a GROUP BY id""",
)

# E: responses
ACTIONS = [*responses.FLAGS, "reboot"]
SQL_ACTION = f"{ACTIONS}[event_id % {len(ACTIONS)} + 1]"
MAY = "n < 18 AND CASE action WHEN 'kill_process' THEN n % 2 = 0 WHEN 'kill_tree' THEN n % 3 = 0 WHEN 'quarantine_file' THEN n % 4 = 0 WHEN 'collect_artifacts' THEN n % 6 > 0 WHEN 'reboot' THEN false ELSE n % 5 = 0 END"


def policies(t: DataFrame) -> DataFrame:
    n = F.substring("host_id", 6, 2).cast("int")
    flags = {"kill_process": n % 2 == 0, "kill_tree": n % 3 == 0, "quarantine": n % 4 == 0, "isolate": n % 5 == 0, "collect": F.when(n % 6 > 0, True)}
    return t.select("host_id").distinct().where(n < 18).select("host_id", *[v.alias(f"allow_{k}") for k, v in flags.items()])


def _decided(t: DataFrame) -> DataFrame:
    """Findings of three rules and a whole month at once, so that some repeat within two seconds; one in eleven has no response."""
    found = t.where("class_uid = 2004").withColumns({"observed_at": F.date_trunc("month", "observed_at"), "rule_uid": F.concat(F.lit("rule-"), (F.col("pid") % 3).cast("string"))})
    action = F.when(F.col("event_id") % 11 > 0, pick(ACTIONS, "event_id"))
    return alerts.decide_responses(found, policies(t), "cmdline", action).select("event_id", "action", "outcome")


register(
    "e9_decide_responses", _decided,
    f"""WITH a AS (SELECT event_id, 'rule-' || pid % 3 AS rule_uid, host_id, date_trunc('month', observed_at) AS d, cmdline, CASE WHEN event_id % 11 > 0 THEN {SQL_ACTION} END AS action, substr(host_id, 6, 2)::INT AS n FROM t WHERE class_uid = 2004),
b AS (SELECT *, action IN ('isolate_host', 'unisolate_host') AS whole, CASE WHEN action IN ('isolate_host', 'unisolate_host') THEN action ELSE coalesce(cmdline, '') END AS target FROM a),
c AS (SELECT *, coalesce(({MAY}) AND target <> '' AND action IS NOT NULL, false) AS may FROM b),
r AS (SELECT event_id, row_number() OVER (PARTITION BY rule_uid, host_id, target, d ORDER BY event_id) = 1 AS ran FROM c WHERE may)
SELECT event_id, action, CASE WHEN action IS NULL THEN NULL WHEN NOT may THEN 'would_have_executed' WHEN ran THEN 'executed' ELSE 'deduped' END AS outcome FROM c LEFT JOIN r USING (event_id)""",
)


def _two_rules(t: DataFrame) -> DataFrame:
    """Every event has findings of two rules, one of them twice, all at one time of the day."""
    found = t.where("class_uid = 2004").withColumn("observed_at", F.date_trunc("day", "observed_at"))
    rule = F.explode(F.array(F.lit("rule-a"), F.lit("rule-b"), F.lit("rule-b")))
    return alerts.decide_responses(found.withColumn("rule_uid", rule), policies(t), "cmdline", F.lit("collect_artifacts")).select("event_id", "rule_uid", "outcome")


register(
    "e9_two_rules", _two_rules,
    """WITH a AS (SELECT event_id, host_id, date_trunc('day', observed_at) AS d, coalesce(cmdline, '') AS target, unnest(['rule-a', 'rule-b', 'rule-b']) AS rule_uid, unnest([1, 1, 2]) AS copy, substr(host_id, 6, 2)::INT AS n FROM t WHERE class_uid = 2004),
c AS (SELECT *, n < 18 AND n % 6 > 0 AND target <> '' AS may FROM a)
SELECT event_id, rule_uid, CASE WHEN NOT may THEN 'would_have_executed' WHEN row_number() OVER (PARTITION BY rule_uid, host_id, target, d, may ORDER BY event_id, copy) = 1 THEN 'executed' ELSE 'deduped' END AS outcome FROM c""",
)


def _permitted(t: DataFrame) -> DataFrame:
    each = F.explode(F.array(*map(F.lit, ACTIONS))).alias("action")
    asked = t.select("host_id").distinct().select("host_id", each).join(policies(t), "host_id", "left")
    return asked.select("host_id", "action", responses.permits(F.col("action")).alias("allowed"))


register(
    "e11_permits", _permitted,
    f"WITH a AS (SELECT DISTINCT host_id, unnest({ACTIONS}) AS action, substr(host_id, 6, 2)::INT AS n FROM t) SELECT host_id, action, {MAY} AS allowed FROM a",
)
register(
    "e17_list_policies", lambda t: responses.list_policies(host_table(t), policies(t)),
    f"""WITH {ALERTS} SELECT host_id, hostname, n < 18 AND n % 2 = 0 AS allow_kill_process, n < 18 AND n % 3 = 0 AS allow_kill_tree, n < 18 AND n % 4 = 0 AS allow_quarantine, n < 18 AND n % 5 = 0 AS allow_isolate,
n < 18 AND n % 6 > 0 AS allow_collect FROM (SELECT *, substr(host_id, 6, 2)::INT AS n FROM hs)""",
)

# F: search
SUMMARY = "CASE class_uid WHEN 1007 THEN concat_ws(' ', exec_path, cmdline) WHEN 1001 THEN file_path WHEN 4001 THEN protocol || ' ' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port ELSE rule_uid END AS summary"
FOUND = f"SELECT event_id, host_id, class_uid, severity_id, observed_at, {SUMMARY} FROM t"


def _pages(t: DataFrame) -> DataFrame:
    found = search.search(t)
    return search.page_with_cursor(found, 50, ("2024-01-15 00:00:00", 0)).unionByName(search.page_with_cursor(found.where("event_id % 97 = 0"), 500))


register(
    "f2_page", _pages,
    f"""WITH f AS ({FOUND}), a AS (SELECT * FROM f WHERE (observed_at, event_id) < (TIMESTAMP '2024-01-15', 0) ORDER BY observed_at DESC, event_id DESC LIMIT 51),
b AS (SELECT * FROM f WHERE event_id % 97 = 0 ORDER BY observed_at DESC, event_id DESC LIMIT 501),
n AS (SELECT *, 50 AS size, row_number() OVER w AS k, count(*) OVER () AS n FROM a WINDOW w AS (ORDER BY observed_at DESC, event_id DESC)
  UNION ALL SELECT *, 500, row_number() OVER w, count(*) OVER () FROM b WINDOW w AS (ORDER BY observed_at DESC, event_id DESC)),
c AS (SELECT size, max(strftime(observed_at, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(observed_at) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((epoch_us(observed_at) % 1000000)::VARCHAR, 6, '0'), '0') END || '|' || event_id) AS cur FROM n WHERE k = size GROUP BY size)
SELECT event_id, host_id, class_uid, severity_id, observed_at, summary, CASE WHEN n > size THEN cur END AS next_cursor FROM n LEFT JOIN c USING (size) WHERE k <= size""",
)


def _techniques(t: DataFrame) -> DataFrame:
    named = classes.flatten_finding(classes.decode(events(t), 2004)).select("event_id", "mitre_techniques")
    # decoded rows are far more than their table's size lets Spark guess: never broadcast
    return search.search(t.join(named.hint("merge"), "event_id", "left"), technique="T1042.001")


register("f4_technique", _techniques, f"{FOUND} WHERE class_uid = 2004 AND event_id % 90 = 42 AND event_id % 2 = 0")


def _resolved(t: DataFrame) -> DataFrame:
    asked = t.select(F.explode(F.array(F.col("host_id"), F.concat(F.lit("Box-"), (F.col("event_id") % 6).cast("string")))).alias("asked"))
    return search.resolve_host(host_table(t), asked)


register(
    "f7_resolve_host", _resolved,
    f"WITH {ALERTS} SELECT hostname AS asked, arg_max(host_id, (enrolled_at, host_id)) AS host_id FROM hs GROUP BY 1 UNION SELECT host_id, host_id FROM hs",
)


def _details(t: DataFrame) -> DataFrame:
    e = kept(events(t).select("event_id", "host_id", "class_uid", "payload"), "payloads")
    flat = {1001: classes.flatten_file, 1007: classes.flatten_process, 2004: classes.flatten_finding, 4001: classes.flatten_network}
    tables = {c: f(classes.decode(e, c)) for c, f in flat.items()}
    wanted = t.where("event_id % 10 = 3").select("event_id").unionByName(t.select((F.col("event_id") + 10_000_000).alias("event_id")).limit(1))
    return search.get_events(tables, wanted).select("event_id", "class_uid", "host_id", "exec_path", "file_path", "dst_ip", "rule_uid")


register(
    "f8_event_detail", _details,
    """SELECT event_id, class_uid, host_id, CASE WHEN class_uid = 1007 THEN exec_path END AS exec_path, CASE WHEN class_uid = 1001 THEN file_path END AS file_path,
CASE WHEN class_uid = 4001 THEN dst_ip END AS dst_ip, CASE WHEN class_uid = 2004 THEN rule_uid END AS rule_uid FROM t WHERE event_id % 10 = 3""",
)
register(
    "f9_enrich_hits",
    lambda t: search.enrich_hits(search.search(t, severity=4), host_table(t), events(t).select("event_id", F.col("payload").alias("raw"))).select("event_id", "hostname", "rule_uid", "rule_name"),
    f"""WITH {ALERTS} SELECT event_id, coalesce(hostname, '') AS hostname, CASE WHEN class_uid = 2004 THEN rule_uid END AS rule_uid, CASE WHEN class_uid = 2004 THEN 'Rule ' || rule_uid END AS rule_name
FROM t LEFT JOIN hs USING (host_id) WHERE severity_id >= 4""",
)
register(
    "f10_labels",
    lambda t: t.select("event_id", search.class_label(F.when(F.col("event_id") % 10 == 0, 6000).otherwise(F.col("class_uid"))).alias("class_label"), search.severity_label(F.col("severity_id") + F.when(F.col("event_id") % 7 == 0, 5).otherwise(0)).alias("severity_label")),
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'class 6000' WHEN class_uid = 1001 THEN 'file' WHEN class_uid = 1007 THEN 'process' WHEN class_uid = 2004 THEN 'detection' ELSE 'network' END AS class_label,
coalesce(['info', 'low', 'medium', 'high', 'critical', 'fatal'][severity_id + CASE WHEN event_id % 7 = 0 THEN 5 ELSE 0 END], '—') AS severity_label FROM t""",
)


def _history(t: DataFrame) -> DataFrame:
    history = t.select(F.col("event_id").alias("id"), F.col("user_name").alias("user_id"), pick(["events", "alerts"], "event_id").alias("surface"), "raw", F.col("observed_at").alias("created_at"))
    return search.recent_queries(history, "user7", "alerts", 20).unionByName(search.recent_queries(history, "user8", n=99))


register(
    "f12_recent_queries", _history,
    """WITH h AS (SELECT event_id AS id, user_name AS user_id, ['events', 'alerts'][event_id % 2 + 1] AS surface, raw, observed_at AS created_at FROM t)
(SELECT * FROM h WHERE user_id = 'user7' AND surface = 'alerts' ORDER BY created_at DESC, id DESC LIMIT 20) UNION ALL (SELECT * FROM h WHERE user_id = 'user8' ORDER BY created_at DESC, id DESC LIMIT 50)""",
)
register(
    "f13_saved_filters",
    lambda t: search.evaluate_saved(t, {"bash": bash(), "severe": F.col("severity_id") >= 4, "zero": m("dst_ip").cidr("10.0.0.0/16"), "gone": None}),
    """SELECT 'bash' AS name, count(*) FILTER (WHERE ends_with(exec_path, '/bash')) AS n, false AS deleted FROM t UNION ALL SELECT 'severe', count(*) FILTER (WHERE severity_id >= 4), false FROM t
UNION ALL SELECT 'zero', count(*) FILTER (WHERE starts_with(dst_ip, '10.0.')), false FROM t UNION ALL SELECT 'gone', 0, true""",
)


# G: graphs
def processes(t: DataFrame) -> DataFrame:
    return t.where("class_uid = 1007")


FIRST = "fs AS (SELECT host_id, pid, arg_min(parent_pid, (observed_at, event_id)) AS parent_pid, arg_min(exec_path, (observed_at, event_id)) AS exec_path, min(observed_at) AS observed_at FROM t WHERE class_uid = 1007 GROUP BY 1, 2)"
register(
    "g5_tree_status", lambda t: graph.tree_status(processes(t), t.select("host_id", (F.col("pid") % 4 + F.when(F.col("pid") > 98, 500).otherwise(0)).alias("root")), fanout=3, cap=5),
    f"""WITH {FIRST}, b AS (SELECT *, row_number() OVER w AS rk FROM fs WINDOW w AS (PARTITION BY host_id, parent_pid ORDER BY observed_at, pid)),
q AS (SELECT DISTINCT host_id, pid % 4 + CASE WHEN pid > 98 THEN 500 ELSE 0 END AS root FROM t),
r AS (SELECT q.host_id, q.root, fs.pid, 0 AS depth, [fs.pid] AS path FROM q JOIN fs ON fs.host_id = q.host_id AND fs.pid = q.root
  UNION ALL SELECT r.host_id, r.root, b.pid, r.depth + 1, list_append(r.path, b.pid) FROM r JOIN b ON b.host_id = r.host_id AND b.parent_pid = r.pid WHERE b.rk <= 3 AND r.depth < 4 AND NOT list_contains(r.path, b.pid)),
n AS (SELECT host_id, root, count(*) AS n FROM r GROUP BY 1, 2)
SELECT host_id, root, least(coalesce(n, 0), 5) AS n_nodes, greatest(coalesce(n, 0) - 5, 0) AS truncated, n IS NULL AS not_found FROM q LEFT JOIN n USING (host_id, root)""",
)


def members(t: DataFrame) -> DataFrame:
    """Alerts of a rule and host; one event in thirteen is one that no table has."""
    gone = F.when(F.col("event_id") % 13 == 0, F.col("event_id") + 10_000_000).otherwise(F.col("event_id"))
    return t.where("severity_id >= 4").select(F.concat_ws("@", "rule_uid", "host_id").alias("alert_id"), gone.alias("event_id"))


register(
    "g6_flow_nodes", lambda t: graph.flow_nodes(members(t), t),
    r"""WITH a AS (SELECT rule_uid || '@' || host_id AS alert_id, event_id + CASE WHEN event_id % 13 = 0 THEN 10000000 ELSE 0 END AS event_id FROM t WHERE severity_id >= 4),
k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY event_id::VARCHAR) <= 32)
SELECT alert_id, k.event_id, CASE class_uid WHEN 1007 THEN 'proc pid=' || pid || '\n' || exec_path WHEN 1001 THEN 'file\n' || file_path WHEN 4001 THEN 'net ' || protocol || '\n' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port
WHEN 2004 THEN 'alert\n' || rule_uid ELSE 'event N/A\n' || k.event_id END AS label,
CASE class_uid WHEN 1007 THEN 'rectangle' WHEN 1001 THEN 'page' WHEN 4001 THEN 'cylinder' WHEN 2004 THEN 'diamond' ELSE 'circle' END AS shape, class_uid IS NOT NULL AS found FROM k LEFT JOIN t ON t.event_id = k.event_id""",
)


def _keys(t: DataFrame) -> DataFrame:
    """An alert is a rule's and host's events of one day."""
    alert_id = F.concat_ws("@", "rule_uid", "host_id", F.date_format("observed_at", "yyyy-MM-dd"))
    grouped = t.groupBy(alert_id.alias("alert_id")).agg(F.collect_list("event_id").alias("event_ids"))
    return grouped.select("alert_id", graph.graph_key(F.col("alert_id"), F.col("event_ids")).alias("key"))


register(
    "g8_graph_key", _keys,
    """WITH a AS (SELECT rule_uid || '@' || host_id || '@' || strftime(observed_at, '%Y-%m-%d') AS alert_id, event_id FROM t)
SELECT alert_id, sha256(alert_id || '|' || array_to_string(list_sort(list(event_id::VARCHAR)), ',')) AS key FROM a GROUP BY 1""",
)
