"""All registered queries of the telemetry operators, each beside its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.predicates import m, selection
from sentrylake.operators import alerts, enrich, fleet, followups, graph, responses, rules, search
from sentrylake.operators.correlate import count_over, near
from sentrylake.plans.catalog import DAY, ORACLE, QUERIES, now, pick, predicate, register  # noqa: F401  the entry reads both tables here
from sentrylake.plans import detection, fleetwide, intake, lookups, processes, streams  # noqa: F401  they register more
from sentrylake.sources import decode


# C: field-match predicates
predicate("c1_equals", lambda: m("exec_path").equals("/usr/bin/wget", "/bin/bash"), "lower(exec_path) IN ('/usr/bin/wget', '/bin/bash')")
predicate("c2_contains", lambda: m("cmdline").contains("/DEV/TCP/"), "contains(lower(cmdline), '/dev/tcp/')")
predicate("c3_startswith", lambda: m("file_path").startswith("/var/view"), "starts_with(lower(file_path), '/var/view')")
predicate("c4_endswith", lambda: m("file_path").endswith(".locked"), "ends_with(lower(file_path), '.locked')")
predicate("c5_cased", lambda: m("exec_path").endswith("wget", cased=True), "ends_with(exec_path, 'wget')")
predicate("c6_regex", lambda: m("exec_path").regex("/(curl|wget)$", flags="i"), "regexp_matches(exec_path, '/(curl|wget)$', 'i')")
predicate("c7_cidr_v4", lambda: m("dst_ip").cidr("10.2.0.0/15"), "split_part(dst_ip, '.', 2) IN ('2', '3')")
predicate(
    "c8_cidr_v6",
    lambda: m(F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("event_id") % 16)), F.lit("::1"))).cidr("2001:db8:4::/46"),
    "event_id % 16 BETWEEN 4 AND 7",
)
#: Addresses in many forms, and whether each is one in 2001:db8::/32.
FORMS = {
    "2001:db8::1": True, "2001:DB8::A:0": True, "2001:db8:1:2:3:4:5:6": True, "2001:db8::1.2.3.4": True, "2001:db8:0:0:0:0:255.2.0.4": True, "2001:db8::": True, "2001:db8:1:2:3:4:5::": True,
    "1:2:3:4::5:6:7:8": False, "2001:db8:1::2:3:4:5:6": False, "2001:db8:::2": False, ":2001:db8:3:4:5:6:7:8": False, "2001:db8:3:4:5:6:7:8:": False, "2001:db8:3:4:5:6:7": False, "2001:db8::1::2": False,
    "2001:db8::1.2.3": False, "2001:db8::1.2.3.256": False, "2001:db8::01.2.3.4": False, "2001:db8:1.2.3.4::": False, "2001:db8::12345": False, "2001:db8::g": False, "2001:db8::1%eth0": False, "2001:db9::": False,
    "::ffff:10.0.0.1": False, "::1": False, "::": False, "10.0.0.1": False, "": False, "2001:db8:1:2:3:4:5:6:7": False,
}
predicate("c8_forms", lambda: m(pick(list(FORMS), "event_id")).cidr("2001:db8::/32"), f"{list(FORMS.values())}[event_id % {len(FORMS)} + 1]")
#: IPv4 addresses, mapped in any spelling, in 10.0.0.0/8; a mapped one is in no IPv6 block.
MAPPED4 = {"10.0.0.1": True, "::ffff:10.9.8.7": True, "::FFFF:0a01:0203": True, "0:0:0:0:0:ffff:10.0.0.2": True, "::ffff:11.0.0.1": False, "::10.0.0.1": False, "10.0.0.01": False, "10.0.0": False, "::ffff:10.0.0.1%1": False}
predicate("c7_mapped", lambda: m(pick(list(MAPPED4), "event_id")).cidr("10.0.0.0/8") & ~m(pick(list(MAPPED4), "event_id")).cidr("::/0", "1::/16"), f"{list(MAPPED4.values())}[event_id % {len(MAPPED4)} + 1]")
predicate("c9_numeric", lambda: m("src_port").compare("gte", 5000), "src_port >= 5000")
predicate("c10_value_list", lambda: m("dst_port").equals(22, 9050), "dst_port IN (22, 9050)")
predicate("c11_all_values", lambda: m("cmdline").contains("base64", "echo", all=True), "contains(cmdline, 'base64') AND contains(cmdline, 'echo')")
predicate("c13_null", lambda: m("cmdline").is_absent(), "cmdline IS NULL OR cmdline = ''")
predicate("c14_exists", lambda: m("cmdline").exists(), "cmdline IS NOT NULL AND cmdline <> ''")
predicate("c15_base64", lambda: m("cmdline").contains("/bin/bash -i", encode="base64"), "contains(lower(cmdline), lower(to_base64('/bin/bash -i'::BLOB)))")
predicate("c17_utf16le", lambda: m(F.concat_ws("\0", F.lit("x"), F.split("exec_path", ""), F.lit(""))).wide("bash"), "contains(exec_path, 'bash')")
predicate("c18_utf16be", lambda: m(F.concat_ws("\0", F.lit("x"), F.split("exec_path", ""))).wide("bash", "utf-16-be"), "contains(exec_path, 'bash')")


# R: rules
def bash() -> Column:
    return m("exec_path").endswith("/bash")


def shell() -> Column:
    return m("cmdline").contains("bash -i", "/dev/tcp/", all=True)


predicate(
    "r1_selection_and",
    lambda: selection({"Image": bash(), "CommandLine": shell()}),
    "ends_with(exec_path, '/bash') AND contains(cmdline, 'bash -i') AND contains(cmdline, '/dev/tcp/')",
)
predicate("r2_selection_or", lambda: selection([{"Image": bash()}, {"port": m("dst_port").equals(9050)}]), "ends_with(exec_path, '/bash') OR dst_port = 9050")
predicate("r3_boolean", lambda: bash() & ~m("cmdline").contains("chmod"), "ends_with(exec_path, '/bash') AND NOT coalesce(contains(cmdline, 'chmod'), false)")

def three():
    return [bash(), m("dst_port").equals(22), m("protocol").equals("udp")]


register(
    "r9_mitre",
    lambda t: t.select("event_id", F.explode(rules.mitre(F.array(F.concat(F.lit("attack.t1"), F.lpad((F.col("event_id") % 90).cast("string"), 3, "0"), F.lit(".00"), (F.col("event_id") % 5).cast("string")), F.lit("attack.execution")))).alias("x")).select("event_id", "x.technique", "x.sub"),
    "SELECT event_id, 'T1' || lpad((event_id % 90)::VARCHAR, 3, '0') AS technique, 'T1' || lpad((event_id % 90)::VARCHAR, 3, '0') || '.00' || event_id % 5 AS sub FROM t",
)

# D: correlation
PROC = "class_uid = 1007 AND (ends_with(exec_path, '/bash') OR ends_with(exec_path, '/sudo'))"

def starts():
    return (F.col("class_uid") == 1007) & m("exec_path").endswith("/bash", "/sudo")


def counted(by: str, seconds: int, test: str, where: str = PROC, columns: str = "event_id, n_hits") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""WITH c AS (SELECT *, epoch_us(observed_at) AS us FROM t WHERE {where}),
w AS (SELECT *, count(*) OVER f AS n_hits, min(observed_at) OVER f AS window_start, list_sort(list(event_id) OVER f) AS event_ids
      FROM c WINDOW f AS ({part}ORDER BY us RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND CURRENT ROW))
SELECT {columns} FROM w WHERE n_hits {test}"""


def slim(df: DataFrame) -> DataFrame:
    return df.select("event_id", "n_hits")


register("d1_count_over", lambda t: slim(count_over(t, starts(), ["user_name"], DAY, ">", 1, detail=False)), counted("user_name", DAY, "> 1"))
register("d2_comparison", lambda t: slim(count_over(t, starts(), ["user_name"], DAY, "==", 2, detail=False)), counted("user_name", DAY, "= 2"))
register(
    "d3_composite_key",
    lambda t: slim(count_over(t, starts(), ["user_name", "cmdline"], 2 * DAY, ">=", 2, detail=False)),
    counted("user_name, coalesce(cmdline, '<nil>')", 2 * DAY, ">= 2"),
)
register("d4_global_count", lambda t: slim(count_over(t, starts(), [], 3600, ">", 2, detail=False)), counted("", 3600, "> 2"))
register(
    "d5_fleet_scope",
    lambda t: count_over(t, starts(), ["user_name"], DAY, ">", 1, detail=False).select("event_id", "host_id", "n_hits"),
    counted("user_name", DAY, "> 1", columns="event_id, host_id, n_hits"),
)
register("d6_host_scope", lambda t: slim(count_over(t, starts(), ["host_id", "pid"], 10 * DAY, ">", 1, detail=False)), counted("host_id, pid", 10 * DAY, "> 1"))
register(
    "d7_finding_detail", lambda t: count_over(t, starts(), ["user_name"], DAY, ">=", 2).select("event_id", "user_name", "n_hits", "window_start", "event_ids"),
    counted("user_name", DAY, ">= 2", columns="event_id, user_name, n_hits, window_start, event_ids"),
)
NEAR = """WITH c AS (SELECT *, epoch_us(observed_at) AS us, class_uid = 2004 AS l, class_uid = 4001 AS r FROM t WHERE class_uid IN (2004, 4001)),
w AS (SELECT *, count(*) FILTER (WHERE l) OVER f AS n_left, count(*) FILTER (WHERE r) OVER f AS n_right, min(observed_at) OVER f AS window_start,
      list_sort(list(event_id) FILTER (WHERE l) OVER f) || list_sort(list(event_id) FILTER (WHERE r) OVER f) AS event_ids
      FROM c WINDOW f AS (ORDER BY us RANGE BETWEEN 120000000 PRECEDING AND CURRENT ROW))
SELECT {columns} FROM w WHERE n_left > 0 AND n_right > 0"""
_near = lambda t, detail=True: near(t, F.col("class_uid") == 2004, F.col("class_uid") == 4001, 120, detail=detail)
register("d8_near", lambda t: _near(t, False).select("event_id", "n_left", "n_right"), NEAR.replace("{columns}", "event_id, n_left, n_right"))
register("d9_near_detail", lambda t: _near(t).select("event_id", "window_start", "event_ids"), NEAR.replace("{columns}", "event_id, window_start, event_ids"))

# A: sources and decoding

register(
    "a7_envelope_ids", lambda t: t.select("event_id", decode.canonical_uuid(F.when(F.col("event_id") % 3 == 0, F.upper(F.md5(F.col("event_id").cast("string")))).otherwise(F.lit("bad"))).alias("uid")),
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(CAST(md5(event_id::VARCHAR) AS UUID) AS VARCHAR) ELSE "
    "'00000000-0000-0000-0000-000000000000' END AS uid FROM t",
)
register(
    "a8_severity",
    lambda t: t.select("event_id", decode.severity_of(F.when(F.col("event_id") % 5 == 0, "{}").otherwise(F.to_json(F.struct("severity_id")))).alias("severity")),
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE severity_id END AS severity FROM t",
)
register(
    "a13_replay",
    lambda t: decode.replay(t, 1007, "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("event_id", "observed_at"),
    "SELECT event_id, observed_at FROM t WHERE class_uid = 1007 AND observed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
)
register(
    "a19_hunt_long",
    lambda t: decode.hunt_long(t.select(F.col("rule_uid").alias("query_id"), "host_id", "observed_at", F.array(F.lit("event"), F.lit("pid")).alias("columns"), F.when(F.col("event_id") % 3 == 0, F.array(F.col("event_id").cast("string"))).otherwise(F.array(F.col("event_id").cast("string"), F.col("pid").cast("string"))).alias("values"))),
    "SELECT rule_uid AS query_id, host_id, observed_at, 'event' AS key, event_id::VARCHAR AS value FROM t UNION ALL SELECT rule_uid, host_id, "
    "observed_at, 'pid', CASE WHEN event_id % 3 = 0 THEN '' ELSE pid::VARCHAR END FROM t",
)

# B: enrichment
register(
    "b3_derived_fields", lambda t: t.select("event_id", enrich.type_uid(F.col("class_uid"), F.lit(1)).alias("type_uid"), enrich.basename(F.col("exec_path")).alias("name"), enrich.mode_text(F.col("pid")).alias("mode")),
    "SELECT event_id, class_uid * 100 + 1 AS type_uid, split_part(exec_path, '/', -1) AS name, 'mode:0' || CASE WHEN pid >= 64 THEN (pid // "
    "64)::VARCHAR ELSE '' END || CASE WHEN pid >= 8 THEN (pid // 8 % 8)::VARCHAR ELSE '' END || (pid % 8)::VARCHAR AS mode FROM t",
)
register(
    "b4_carry_state", lambda t: enrich.carry_state(t, ["cmdline"], ["host_id", "pid"], ["observed_at", "event_id"]).select("event_id", "cmdline", "created_at"),
    "SELECT event_id, last_value(cmdline IGNORE NULLS) OVER w AS cmdline, first_value(observed_at) OVER w AS created_at FROM t WINDOW w AS "
    "(PARTITION BY host_id, pid ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING)",
)
register(
    "b5_intervals", lambda t: enrich.intervals(t.withColumn("is_exit", F.col("event_id") % 4 == 0), ["host_id", "pid"]).select("event_id", (F.col("end_us") - F.col("start_us")).alias("lasts_us")),
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(coalesce(lead(us) OVER w, us + 30000000), us + 30000000) ELSE lead(us) OVER w END - "
    "us AS lasts_us FROM (SELECT *, epoch_us(observed_at) AS us FROM t) WINDOW w AS (PARTITION BY host_id, pid ORDER BY us, event_id)",
)
register(
    "b6_join_actor", lambda t: graph.as_of(t.where("class_uid in (1001, 4001)"), t.where("class_uid = 1007"), ["host_id", "pid"], ["exec_path"], 30 * DAY).select("event_id", "actor_exec_path"),
    f"SELECT p.event_id, CASE WHEN epoch_us(p.observed_at) - epoch_us(s.observed_at) <= {30 * DAY * 1_000_000} THEN s.exec_path END AS "
    f"actor_exec_path FROM (SELECT * FROM t WHERE class_uid IN (1001, 4001)) p ASOF LEFT JOIN (SELECT host_id, pid, observed_at, exec_path FROM t "
    f"WHERE class_uid = 1007) s ON p.host_id = s.host_id AND p.pid = s.pid AND p.observed_at >= s.observed_at",
)
register(
    "b8_join_users",
    lambda t: enrich.join_users(t.select("event_id", (F.col("pid") % 9).alias("uid")), t.where("pid < 6").select(F.col("pid").alias("uid"), F.concat(F.lit("u"), "pid").alias("name")).distinct()).select("event_id", "user"),
    "SELECT event_id, CASE WHEN pid % 9 BETWEEN 1 AND 5 THEN 'u' || pid % 9 END AS user FROM t",
)
predicate(
    "b9_path_filter",
    lambda: enrich.path_filter(F.col("file_path"), ["/var/view/**", "/var/*/f1*.txt"], ["/var/view/f2?.txt"]),
    r"(starts_with(file_path, '/var/view/') OR regexp_matches(file_path, '^/var/[^/]*/f1[^/]*\.txt$')) AND NOT regexp_matches(file_path, '^/var/view/f2[^/]\.txt$')",
)
register(
    "b10_resolve_path",
    lambda t: t.select("event_id", enrich.resolve_path(F.concat(F.lit("../x/./"), F.col("user_name")), F.lit("/home/a")).alias("path")),
    "SELECT event_id, '/home/x/' || user_name AS path FROM t",
)
register("b12_stamp_host", lambda t: enrich.stamp_host(t, "host-00").select("event_id", "host_id"), "SELECT event_id, 'host-00' AS host_id FROM t")

# E: alerts


def _rules_of(t: DataFrame) -> DataFrame:
    """Windows: none, an hour, six hours or a day, by the rule's number."""
    return t.select("rule_uid").distinct().withColumn("window_s", F.element_at(F.array(F.lit(None).cast("int"), F.lit(3600), F.lit(21600), F.lit(DAY)), F.substring("rule_uid", -2, 2).cast("int") % 4 + 1))


FOLD = f"""WITH a AS (SELECT event_id, rule_uid, host_id, epoch_us(observed_at) AS us, [NULL, 3600, 21600, {DAY}][CAST(substr(rule_uid, -2) AS INT) % 4 + 1] AS w FROM t WHERE class_uid = 2004),
o AS (SELECT *, row_number() OVER (PARTITION BY rule_uid, host_id ORDER BY us, event_id) AS k FROM a),
f AS (SELECT event_id, rule_uid, host_id, us, w, k, true AS kept, us AS last FROM o WHERE k = 1
  UNION ALL SELECT o.event_id, o.rule_uid, o.host_id, o.us, o.w, o.k, o.w IS NULL OR f.last <= o.us - o.w * 1000000::BIGINT, CASE WHEN o.w IS NULL OR f.last <= o.us - o.w * 1000000::BIGINT THEN o.us ELSE f.last END
  FROM f JOIN o ON o.rule_uid = f.rule_uid AND o.host_id = f.host_id AND o.k = f.k + 1)"""
_deduped = lambda t: alerts.dedupe_alerts(t.where("class_uid = 2004"), _rules_of(t))
register("e2_dedupe_alerts", _deduped, f"{FOLD} SELECT event_id, rule_uid, host_id, kept FROM f")
_log = lambda t, names: t.select(F.col("pid").alias("id"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int")).alias("to_status"))


def fold_sql(names: list[str], start: str, moves: dict) -> str:
    pairs = ", ".join(f"'{a}>{b}'" for a, bs in moves.items() for b in bs)
    return f"""WITH l AS (SELECT pid AS id, {names}[event_id % {len(names)} + 1] AS s, row_number() OVER (PARTITION BY pid ORDER BY event_id) AS k FROM t),
f AS (SELECT DISTINCT id, 0::BIGINT AS k, '{start}' AS status, 0 AS refused FROM l
  UNION ALL SELECT l.id, l.k, CASE WHEN f.status || '>' || l.s IN ({pairs}) THEN l.s ELSE f.status END, f.refused + CASE WHEN f.status || '>' || l.s IN ({pairs}) THEN 0 ELSE 1 END
  FROM f JOIN l ON l.id = f.id AND l.k = f.k + 1)
SELECT id, arg_max(status, k) AS status, max(refused) AS refused FROM f GROUP BY id"""


STATES, STEPS = ["acknowledged", "in_progress", "closed", "new"], ["running", "done", "failed", "denied", "reverted"]
register("e6_alert_states", lambda t: alerts.fold_transitions(_log(t, STATES), "new", alerts.ALERT_MOVES), fold_sql(STATES, "new", alerts.ALERT_MOVES))
register("e13_response_states", lambda t: alerts.fold_transitions(_log(t, STEPS), "pending", alerts.RESPONSE_MOVES), fold_sql(STEPS, "pending", alerts.RESPONSE_MOVES))
register(
    "e16_responses_per_host",
    lambda t: search.newest_per(t.where("class_uid = 2004"), "host_id", 5, [F.desc("observed_at"), F.desc("event_id")]).select("host_id", "event_id", "rank"),
    "SELECT host_id, event_id, rank FROM (SELECT host_id, event_id, row_number() OVER (PARTITION BY host_id ORDER BY observed_at DESC, event_id "
    "DESC) AS rank FROM t WHERE class_uid = 2004) WHERE rank <= 5",
)

# F: search
SUMMARY = "CASE class_uid WHEN 1007 THEN concat_ws(' ', exec_path, cmdline) WHEN 1001 THEN file_path WHEN 4001 THEN protocol || ' ' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port ELSE rule_uid END AS summary"
FOUND = f"SELECT event_id, host_id, class_uid, severity_id, observed_at, {SUMMARY} FROM t"
register(
    "f1_search",
    lambda t: search.search(t, hosts=["host-01", "host-07"], severity=2, classes=[1007, 4001]),
    f"{FOUND} WHERE host_id IN ('host-01', 'host-07') AND severity_id >= 2 AND class_uid IN (1007, 4001)",
)
register("f3_summary", lambda t: search.search(t).select("event_id", "summary"), f"SELECT event_id, {SUMMARY} FROM t")
register("f4_rule_filter", lambda t: search.search(t, rule_uid="rule-03"), f"{FOUND} WHERE class_uid = 2004 AND rule_uid = 'rule-03'")
register("f5_raw_contains", lambda t: search.search(t, raw_contains=": 42"), f"{FOUND} WHERE contains(raw, ': 42')")
register(
    "f11_trim_history",
    lambda t: search.newest_per(t, "user_name", 50, [F.desc("observed_at"), F.desc("event_id")]).select("user_name", "event_id"),
    "SELECT user_name, event_id FROM t QUALIFY row_number() OVER (PARTITION BY user_name ORDER BY observed_at DESC, event_id DESC) <= 50",
)

# G: process graph
FIRST = "fs AS (SELECT host_id, pid, arg_min(parent_pid, (observed_at, event_id)) AS parent_pid, arg_min(exec_path, (observed_at, event_id)) AS exec_path, min(observed_at) AS observed_at FROM t WHERE class_uid = 1007 GROUP BY 1, 2)"
_procs = lambda t: t.where("class_uid = 1007")
register(
    "g1_process_at",
    lambda t: graph.as_of(t.where("class_uid = 2004"), _procs(t), ["host_id", "pid"], ["user_name"], DAY * 7).select("event_id", "actor_user_name"),
    f"SELECT p.event_id, CASE WHEN epoch_us(p.observed_at) - epoch_us(s.observed_at) <= {7 * DAY * 1_000_000} THEN s.user_name END AS "
    f"actor_user_name FROM (SELECT * FROM t WHERE class_uid = 2004) p ASOF LEFT JOIN (SELECT * FROM t WHERE class_uid = 1007) s ON p.host_id = "
    f"s.host_id AND p.pid = s.pid AND p.observed_at >= s.observed_at",
)
register(
    "g2_children",
    lambda t: graph.children(_procs(t)).select("host_id", "parent_pid", "pid", "exec_path", "rank"),
    f"WITH {FIRST} SELECT host_id, parent_pid, pid, exec_path, rank FROM (SELECT *, row_number() OVER (PARTITION BY host_id, parent_pid ORDER BY "
    f"observed_at, pid) AS rank FROM fs) WHERE rank <= 64",
)
register(
    "g3_ancestors", lambda t: graph.ancestors(_procs(t)),
    f"WITH {FIRST}, r AS (SELECT host_id, pid, [pid] AS chain, parent_pid AS next FROM fs UNION ALL SELECT r.host_id, r.pid, list_prepend(fs.pid, "
    f"r.chain), fs.parent_pid FROM r JOIN fs ON fs.host_id = r.host_id AND fs.pid = r.next WHERE NOT list_contains(r.chain, fs.pid) AND "
    f"len(r.chain) < 8) SELECT host_id, pid, arg_max(chain, len(chain)) AS chain FROM r GROUP BY 1, 2",
)

# H: fleet
register(
    "h10_sample_by_level",
    lambda t: fleet.sample_by_level(t, "elevated").select("event_id"),
    "SELECT event_id FROM t WHERE class_uid NOT IN (1001, 4001) OR ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 1000 < 500",
)
register(
    "h13_cap_rows",
    lambda t: search.newest_per(t, "host_id", 100, [F.asc("event_id")]).select("host_id", "event_id"),
    "SELECT host_id, event_id FROM t QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY event_id) <= 100",
)

# E: response actions
ACTIONS = [*responses.FLAGS, "reboot"]
_action = lambda: F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("event_id") % len(ACTIONS) + 1).cast("int"))
SQL_ACTION = f"{ACTIONS}[event_id % {len(ACTIONS)} + 1]"


def _policies(t: DataFrame) -> DataFrame:
    n = F.substring("host_id", 6, 2).cast("int")
    flags = {"kill_process": n % 2 == 0, "kill_tree": n % 3 == 0, "quarantine": n % 4 == 0, "isolate": n % 5 == 0, "collect": F.when(n % 6 > 0, True)}
    return t.select("host_id").distinct().where(n < 18).select("host_id", *[v.alias(f"allow_{k}") for k, v in flags.items()])


register(
    "e10_dedupe_responses", lambda t: responses.dedupe_responses(t.where("class_uid = 2004"), ["rule_uid", "user_name"], DAY),
    f"""WITH l AS (SELECT rule_uid, user_name, event_id, epoch_us(observed_at) AS us, row_number() OVER (PARTITION BY rule_uid, user_name ORDER BY observed_at, event_id) AS k FROM t WHERE class_uid = 2004),
f AS (SELECT *, us AS last, true AS executed FROM l WHERE k = 1
  UNION ALL SELECT l.*, CASE WHEN l.us - f.last > {DAY}000000 THEN l.us ELSE f.last END, l.us - f.last > {DAY}000000 FROM f JOIN l ON l.rule_uid = f.rule_uid AND l.user_name = f.user_name AND l.k = f.k + 1)
SELECT rule_uid, user_name, event_id, executed FROM f""",
)
register(
    "e12_dispatch_status", lambda t: responses.dispatch_status(t.where("class_uid = 2004").select("event_id", "host_id", _action().alias("action")), _policies(t)),
    f"""WITH a AS (SELECT event_id, host_id, {SQL_ACTION} AS action, substr(host_id, 6, 2)::INT AS n FROM t WHERE class_uid = 2004),
p AS (SELECT *, n < 18 AND CASE action WHEN 'kill_process' THEN n % 2 = 0 WHEN 'kill_tree' THEN n % 3 = 0 WHEN 'quarantine_file' THEN n % 4 = 0 WHEN 'collect_artifacts' THEN n % 6 > 0 WHEN 'reboot' THEN false ELSE n % 5 = 0 END AS ok FROM a)
SELECT event_id, host_id, action, CASE WHEN ok THEN 'pending' ELSE 'denied_by_policy' END AS status, CASE WHEN NOT ok THEN 'host policy does not permit ' || action END AS detail FROM p""",
)


def _absorbed(t: DataFrame) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ["pending", "running", "done"])), (F.col("pid") % 3 + 1).cast("int"))
    ours = t.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), "rule_uid", _action().alias("action"), status.alias("status"))
    rule = F.when(F.col("event_id") % 9 > 0, F.col("rule_uid"))
    came = t.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), rule.alias("rule_uid"), _action().alias("action"), (F.col("event_id") % 4 == 0).alias("ok"))
    return responses.absorb_results(ours, came)


register(
    "e14_absorb_results", _absorbed,
    f"""SELECT event_id AS id, rule_uid, {SQL_ACTION} AS action,
CASE WHEN event_id % 2 = 0 AND (event_id % 3 = 0 OR pid % 3 < 2) THEN CASE WHEN event_id % 4 = 0 THEN 'done' ELSE 'failed' END ELSE ['pending', 'running', 'done'][pid % 3 + 1] END AS status
FROM t WHERE event_id % 3 <> 0 OR (event_id % 2 = 0 AND event_id % 9 > 0 AND {SQL_ACTION} <> 'reboot')""",
)
register(
    "e15_revert_status",
    lambda t: responses.revert_status(t.select(F.col("event_id").alias("id"), _action().alias("action"), F.element_at(F.array(*map(F.lit, ["done", "failed", "running"])), (F.col("pid") % 3 + 1).cast("int")).alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 1).alias("parent_action"))),
    f"""WITH a AS (SELECT event_id AS id, {SQL_ACTION} AS action, ['done', 'failed', 'running'][pid % 3 + 1] AS status, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS parent_action FROM t),
c AS (SELECT parent_action AS p, bool_or(status = 'done') AS d, bool_or(status <> 'failed') AS l FROM a WHERE parent_action IS NOT NULL GROUP BY 1)
SELECT id, action, parent_action, CASE WHEN status = 'done' AND d THEN 'reverted' ELSE status END AS status, status = 'done' AND action IN ('quarantine_file', 'isolate_host') AND NOT coalesce(l, false) AS reversible FROM a LEFT JOIN c ON c.p = a.id""",
)

# G: trees and flow graphs
register(
    "g4_process_tree", lambda t: graph.process_tree(_procs(t), _procs(t).where("pid <= 3").select("host_id", F.col("pid").alias("root")), fanout=2),
    f"""WITH {FIRST}, b AS (SELECT *, row_number() OVER w AS rk FROM fs WINDOW w AS (PARTITION BY host_id, parent_pid ORDER BY observed_at, pid)),
r AS (SELECT host_id, pid AS root, pid, NULL::BIGINT AS parent, 0 AS depth, '' AS k, [pid] AS path FROM fs WHERE pid <= 3
  UNION ALL SELECT r.host_id, r.root, b.pid, r.pid, r.depth + 1, r.k || lpad(b.rk::VARCHAR, 4, '0'), list_append(r.path, b.pid) FROM r JOIN b ON b.host_id = r.host_id AND b.parent_pid = r.pid WHERE b.rk <= 2 AND r.depth < 4 AND NOT list_contains(r.path, b.pid)),
m AS (SELECT host_id, parent_pid AS pid, count(*) > 2 AS more FROM fs GROUP BY 1, 2)
SELECT host_id, root, pid, parent, depth, CAST(row_number() OVER (PARTITION BY host_id, root ORDER BY depth, k) AS INT) AS place, depth = 0 AS is_root, coalesce(more, false) AS has_more_children FROM r LEFT JOIN m USING (host_id, pid)""",
)
register(
    "g6_flow_edges", lambda t: graph.flow_edges(t.where("severity_id >= 4").select(F.concat_ws("@", "rule_uid", "host_id").alias("alert_id"), "event_id"), t, DAY),
    f"""WITH a AS (SELECT rule_uid || '@' || host_id AS alert_id, event_id FROM t WHERE severity_id >= 4 QUALIFY row_number() OVER (PARTITION BY rule_uid, host_id ORDER BY event_id::VARCHAR) <= 32),
p AS (SELECT event_id, host_id, observed_at, CASE class_uid WHEN 1007 THEN parent_pid ELSE pid END AS actor FROM t WHERE class_uid <> 2004),
s AS (SELECT event_id AS actor_id, host_id, pid, observed_at FROM t WHERE class_uid = 1007),
e AS (SELECT p.event_id, s.actor_id FROM p ASOF JOIN s ON p.host_id = s.host_id AND p.actor = s.pid AND p.observed_at >= s.observed_at WHERE p.actor > 0 AND s.actor_id <> p.event_id AND epoch_us(p.observed_at) - epoch_us(s.observed_at) <= {DAY}000000)
SELECT alert_id, actor_id, event_id FROM a JOIN e USING (event_id)""",
)
register(
    "g7_node_labels", lambda t: t.select("event_id", graph.node_label(F.col("class_uid")).alias("label"), graph.node_shape(F.col("class_uid")).alias("shape")),
    r"""SELECT event_id, CASE class_uid WHEN 1007 THEN 'proc pid=' || pid || '\n' || exec_path WHEN 1001 THEN 'file\n' || file_path WHEN 4001 THEN 'net ' || protocol || '\n' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port ELSE 'alert\n' || rule_uid END AS label,
CASE class_uid WHEN 1007 THEN 'rectangle' WHEN 1001 THEN 'page' WHEN 4001 THEN 'cylinder' ELSE 'diamond' END AS shape FROM t""",
)


# H: cross-check and hunts
def _cross_checked(t: DataFrame) -> DataFrame:
    since = F.date_trunc("hour", F.col("observed_at").cast("timestamp"))
    spans = t.groupBy("host_id", since.alias("since_at")).agg(F.count(F.lit(1)).alias("count_observed"))
    spans = spans.withColumn("until_at", F.col("since_at") + F.expr("INTERVAL 90 MINUTES")).withColumn("id", F.concat_ws("@", "host_id", F.unix_micros("since_at").cast("string")))
    return fleet.cross_check(spans, t.where("class_uid IN (1007, 2004)")).select("id", "count_observed", "count_expected", "mismatch")


register(
    "h6_cross_check", _cross_checked,
    """WITH s AS (SELECT host_id, date_trunc('hour', observed_at) AS since, count(*) AS count_observed FROM t GROUP BY 1, 2),
n AS (SELECT s.host_id, s.since, count(*) AS k FROM s JOIN t ON t.host_id = s.host_id AND t.observed_at >= s.since AND t.observed_at < s.since + INTERVAL 90 MINUTE WHERE t.class_uid IN (1007, 2004) GROUP BY 1, 2)
SELECT host_id || '@' || epoch_us(since) AS id, count_observed, coalesce(k, 0) AS count_expected, abs(count_observed - coalesce(k, 0)) > 1 AS mismatch FROM s LEFT JOIN n USING (host_id, since)""",
)


def _hunted(t: DataFrame) -> DataFrame:
    k = F.substring("rule_uid", 6, 2).cast("int")
    hunts = t.groupBy(F.col("rule_uid").alias("id"), (k * 2).alias("target_host_count"), (k % 4 * 10 * DAY).alias("timeout_secs")).agg(F.min("observed_at").alias("dispatched_at"))
    return fleet.hunt_status(hunts, t.select(F.col("rule_uid").alias("id"), "host_id", "observed_at"), now()).select("id", "completed_host_count", "status")


register(
    "h15_hunt_status", _hunted,
    f"""WITH h AS (SELECT rule_uid AS id, substr(rule_uid, 6, 2)::INT AS k, min(epoch_us(observed_at)) AS d FROM t GROUP BY 1, 2),
c AS (SELECT h.id, count(DISTINCT t.host_id) AS n FROM h JOIN t ON t.rule_uid = h.id AND epoch_us(t.observed_at) <= h.d + (k % 4)::BIGINT * {DAY * 10}000000 GROUP BY 1)
SELECT id, n AS completed_host_count, CASE WHEN k = 0 THEN 'timed_out' WHEN n >= k * 2 THEN 'completed' WHEN epoch_us(TIMESTAMP '2024-01-31') > d + (k % 4)::BIGINT * {DAY * 10}000000 THEN 'timed_out' ELSE 'running' END AS status FROM h JOIN c USING (id)""",
)

# B: late hashes
register(
    "b11_followups", lambda t: followups.merge_followups(t.where("class_uid = 1001").select("event_id", "file_path"), t.where("class_uid = 4001").select((F.col("event_id") + 1).alias("correlation_uid"), F.sha2("raw", 256).alias("sha256"))),
    "SELECT e.event_id, e.file_path, sha256(f.raw) AS sha256 FROM t e LEFT JOIN t f ON f.class_uid = 4001 AND f.event_id + 1 = e.event_id WHERE e.class_uid = 1001",
)
