"""Queries of sources, decoding, sinks and enrichment, each beside its DuckDB text."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.predicates import project_fields
from sentrylake.operators import enrich
from sentrylake.plans.catalog import now, pick, register
from sentrylake.sources import classes, decode, inventory, store

MILLIS = "epoch_us(observed_at) // 1000"
UID = "CAST(CAST(md5(event_id::VARCHAR) AS UUID) AS VARCHAR)"


def uid(n: Column) -> Column:
    return decode.canonical_uuid(F.md5(n.cast("string")))


def payload(t: DataFrame, class_uid: Column, activity: Column, time: Column) -> DataFrame:
    """`t` with a JSON payload that has the fields of every class; a field of a class is left out where `gap` is set."""
    gap = F.coalesce(F.col("gap"), F.lit(False))
    whole = lambda c: F.when(~gap, c)
    named = lambda **f: F.struct(*[c.alias(n) for n, c in f.items()])
    path = F.col("exec_path")
    own = named(pid=F.col("pid"), name=enrich.basename(path), cmd_line=F.col("cmdline"), file=named(path=path), user=named(name=F.col("user_name")))
    parent = named(pid=F.col("parent_pid"), cmd_line=F.lit("init"), file=named(path=F.lit("/sbin/init")))
    process = named(pid=whole(F.col("pid")), name=enrich.basename(path), cmd_line=F.col("cmdline"), file=named(path=path), user=named(name=F.col("user_name")), parent_process=parent)
    attack = named(
        technique=named(uid=F.concat(F.lit("T1"), F.lpad((F.col("event_id") % 90).cast("string"), 3, "0"))),
        sub_technique=F.when(F.col("event_id") % 2 == 0, named(uid=F.concat(F.lit("T1"), F.lpad((F.col("event_id") % 90).cast("string"), 3, "0"), F.lit(".001")))),
    )
    body = F.struct(
        named(uid=uid(F.col("event_id")), original_time=F.when(F.col("event_id") % 3 > 0, time), labels=F.array(F.lit("x"))).alias("metadata"),
        class_uid.alias("class_uid"), activity.alias("activity_id"), F.col("severity_id"), time.alias("time"), named(uid=F.col("host_id")).alias("device"),
        named(process=own, user=named(name=F.col("user_name"))).alias("actor"), process.alias("process"), F.when(F.col("event_id") % 6 == 0, F.col("event_id") % 5).alias("exit_code"),
        F.struct(whole(F.col("file_path")).alias("path"), whole(enrich.basename(F.col("file_path"))).alias("name"), F.sha2("raw", 256).alias("hashes.sha256")).alias("file"),
        F.when(F.col("event_id") % 7 == 0, named(path=F.concat(F.col("file_path"), F.lit(".new")))).alias("file_diff"),
        named(protocol_name=whole(F.col("protocol"))).alias("connection_info"), named(ip=F.col("src_ip"), port=F.col("src_port")).alias("src_endpoint"),
        named(ip=F.col("dst_ip"), port=F.col("dst_port")).alias("dst_endpoint"),
        named(uid=whole(F.concat(F.lit("f"), F.col("event_id").cast("string"))), title=F.concat(F.lit("found "), F.col("rule_uid")), status=F.lit("New")).alias("finding"),
        named(uid=F.col("rule_uid"), name=F.concat(F.lit("Rule "), F.col("rule_uid"))).alias("rule"),
        F.array(uid(F.col("event_id")), F.lit("bad"), uid(F.col("event_id") + 1)).alias("x_triggering_event_ids"), F.array(attack, attack).alias("attacks"),
        named(name=whole(F.lit("nf_tables"))).alias("kernel"), named(name=whole(F.col("user_name"))).alias("user"),
        named(hostname=whole(F.lit("example.org"))).alias("query"), named(uid=whole(F.lit("c1"))).alias("container"),
    )
    return t.withColumn("payload", F.to_json(body))


def events(t: DataFrame) -> DataFrame:
    plain = t.withColumn("gap", F.lit(False))
    return payload(plain, F.col("class_uid"), 1 + F.col("event_id") % 3, F.unix_millis(F.col("observed_at").cast("timestamp")))


def _decoded(t: DataFrame) -> DataFrame:
    broken = F.when(F.col("event_id") % 11 == 0, "{").when(F.col("event_id") % 13 == 0, "").otherwise(F.col("payload"))
    e = events(t).withColumn("payload", broken)
    each = [classes.decode(e, c).select("event_id", "class_uid", F.col("p.activity_id").alias("activity_id"), F.col("p.metadata.uid").alias("uid")) for c in classes.STORED]
    return reduce(lambda a, b: a.unionByName(b), each)


register(
    "a1_decode", _decoded,
    f"SELECT event_id, class_uid, CAST(1 + event_id % 3 AS INT) AS activity_id, {UID} AS uid FROM t WHERE event_id % 11 <> 0 AND event_id % 13 <> 0",
)


def _split(t: DataFrame) -> DataFrame:
    tables, unknown = classes.split_by_class(t.withColumn("class_uid", F.when(F.col("event_id") % 9 == 0, 1003).otherwise(F.col("class_uid"))))
    counts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(classes.STORED[c]).alias("table"), "n") for c, d in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), [*counts, unknown.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dropped").alias("table"), "n")])


register(
    "a2_split_by_class", _split,
    """SELECT CASE WHEN event_id % 9 = 0 THEN 'dropped' WHEN class_uid = 1001 THEN 'file' WHEN class_uid = 1007 THEN 'process' WHEN class_uid = 2004 THEN 'finding' ELSE 'network' END AS "table", count(*) AS n
FROM t GROUP BY 1""",
)
register(
    "a3_flatten_process", lambda t: classes.flatten_process(classes.decode(events(t), 1007)),
    """SELECT event_id, host_id, CAST(1 + event_id % 3 AS INT) AS activity_id, pid, parent_pid, split_part(exec_path, '/', -1) AS process_name, exec_path, cmdline, user_name,
CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 5 AS INT) END AS exit_code FROM t WHERE class_uid = 1007""",
)
register(
    "a4_flatten_file", lambda t: classes.flatten_file(classes.decode(events(t), 1001)),
    """SELECT event_id, host_id, CAST(1 + event_id % 3 AS INT) AS activity_id, file_path, split_part(file_path, '/', -1) AS file_name, sha256(raw) AS file_hash_sha256,
pid AS actor_pid, split_part(exec_path, '/', -1) AS actor_name FROM t WHERE class_uid = 1001""",
)
register(
    "a5_flatten_network", lambda t: classes.flatten_network(classes.decode(events(t), 4001)),
    """SELECT event_id, host_id, CAST(1 + event_id % 3 AS INT) AS activity_id, protocol, src_ip, src_port, dst_ip, dst_port, pid AS actor_pid, split_part(exec_path, '/', -1) AS actor_name
FROM t WHERE class_uid = 4001""",
)
register(
    "a6_flatten_finding", lambda t: classes.flatten_finding(classes.decode(events(t), 2004)),
    f"""WITH a AS (SELECT *, 'T1' || lpad((event_id % 90)::VARCHAR, 3, '0') AS te FROM t WHERE class_uid = 2004)
SELECT event_id, host_id, CAST(1 + event_id % 3 AS INT) AS activity_id, rule_uid, 'Rule ' || rule_uid AS rule_name, 'f' || event_id AS finding_uid, 'New' AS finding_status,
[{UID}, CAST(CAST(md5((event_id + 1)::VARCHAR) AS UUID) AS VARCHAR)] AS triggering_event_ids,
CASE WHEN event_id % 2 = 0 THEN [te, te || '.001', te, te || '.001'] ELSE [te, te] END AS mitre_techniques FROM a""",
)


def _validated(t: DataFrame) -> DataFrame:
    """Events of all eight classes, two thirds of them with a fault."""
    numbers = sorted(classes.BODY)
    k = F.floor(F.col("event_id") / 8) % 6
    own = t.withColumn("class_uid", pick(numbers, "event_id")).withColumn("gap", k == 2)
    wrong = F.when(k == 3, 9999).otherwise(F.col("class_uid"))
    activity = F.when(k == 0, 0).when(k == 4, 6).otherwise(1)
    time = F.when(k == 1, F.lit(0).cast("bigint")).otherwise(F.unix_millis(F.col("observed_at").cast("timestamp")))
    e = payload(own, wrong, activity, time)
    checked = [classes.validate(classes.decode(e, c), c).select("class_uid", "error") for c in numbers]
    return reduce(lambda a, b: a.unionByName(b), checked).groupBy("class_uid", "error").agg(F.count(F.lit(1)).alias("n"))


register(
    "a9_validate", _validated,
    """WITH a AS (SELECT event_id, CAST([1001, 1003, 1007, 2004, 3002, 4001, 4003, 6000][event_id % 8 + 1] AS INT) AS class_uid, event_id // 8 % 6 AS k FROM t)
SELECT class_uid, CASE k WHEN 3 THEN 'class_uid' WHEN 0 THEN 'activity_id required' WHEN 1 THEN 'time required'
  WHEN 2 THEN CASE class_uid WHEN 1001 THEN 'file.path or file.name required' WHEN 1003 THEN 'kernel.name required' WHEN 1007 THEN 'process.pid required' WHEN 2004 THEN 'finding.uid required'
    WHEN 3002 THEN 'user.name or user.uid required' WHEN 4001 THEN 'connection_info.protocol_name required' WHEN 4003 THEN 'query.hostname required' ELSE 'container.uid or container.name required' END
  WHEN 4 THEN CASE WHEN class_uid = 1001 AND event_id % 7 > 0 THEN 'rename requires file_diff target' END END AS error, count(*) AS n
FROM a GROUP BY 1, 2""",
)
register(
    "a10_write_events", lambda t: store.stored_events(t).select("event_id", "host_id", F.col("event_date").cast("string").alias("event_date")),
    "SELECT event_id, host_id, CAST(CAST(observed_at AS DATE) AS VARCHAR) AS event_date FROM t",
)
register("a11_jsonl", lambda t: store.stored_lines(t.select("event_id", "cmdline", "severity_id")), "SELECT event_id, cmdline, severity_id FROM t")


def _scanned(t: DataFrame) -> DataFrame:
    tables, _ = classes.split_by_class(t)
    return classes.scan(tables, [1007, 4001, 1007, 77]).groupBy("class_uid").agg(F.count(F.lit(1)).alias("n"))


register("a12_scan", _scanned, "SELECT class_uid, count(*) AS n FROM t WHERE class_uid IN (1007, 4001) GROUP BY 1")
register(
    "a14_retention", lambda t: store.apply_retention(t, now(), 20).select("event_id"),
    "SELECT event_id FROM t WHERE date_trunc('day', observed_at) + INTERVAL 20 DAY >= TIMESTAMP '2024-01-31'",
)


def _partitions(t: DataFrame) -> DataFrame:
    """Events of 20 days and findings, as hunt results, of 7, each in a table whose expired days were dropped; the events read by their
    days once more, cut at 10."""
    spark, at = t.sparkSession, datetime(2024, 1, 31)
    tables = {}
    for label, rows, days in (("events", t, 20), ("hunts", t.where("class_uid = 2004"), 7)):
        path = store.shared_path(spark, label)
        decode.write_events(rows, path)
        store.drop_expired(spark, path, at, days)
        tables[label] = store.read_events(spark, path, rows.schema)
    tables["cut"] = store.apply_retention(tables["events"], now(), 10)
    each = [d.select("event_id", F.lit(label).alias("kept_in"), F.col("event_date").cast("string").alias("event_date")) for label, d in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


register(
    "a14_partitions", _partitions,
    "SELECT event_id, l AS kept_in, CAST(CAST(observed_at AS DATE) AS VARCHAR) AS event_date FROM t, (VALUES ('events', 20), ('hunts', 7), ('cut', 10)) v(l, d) "
    "WHERE (l <> 'hunts' OR class_uid = 2004) AND date_trunc('day', observed_at) + to_days(d) >= TIMESTAMP '2024-01-31'",
)


def _feeds(t: DataFrame) -> DataFrame:
    """Entries of four kinds, one in four malformed, each twice."""
    bad, n = F.col("event_id") % 4 == 0, (F.col("event_id") % 50).cast("string")
    kinds = {
        "sha256": F.when(bad, "abc").otherwise(F.upper(F.sha2(n, 256))), "ipv4": F.when(bad, "10.0.0.256").otherwise(F.concat(F.lit(" 10.0.0."), n)),
        "ipv6": F.when(bad, F.concat(F.lit("::ffff:10.0.0."), n)).otherwise(F.concat(F.lit("2001:DB8::"), n)), "domain": F.when(bad, "-bad").otherwise(F.concat(F.lit("Host"), n, F.lit(".Example.org "))),
    }
    each = [decode.ioc_feed(t.select(c.alias("entry")), k).withColumn("kind", F.lit(k)) for k, c in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


FEEDS = """f AS (SELECT DISTINCT k AS kind, CASE k WHEN 'sha256' THEN sha256((event_id % 50)::VARCHAR) WHEN 'ipv4' THEN '10.0.0.' || event_id % 50 WHEN 'ipv6' THEN '2001:db8::' || event_id % 50
  ELSE 'host' || event_id % 50 || '.example.org' END AS entry FROM t, (VALUES ('sha256'), ('ipv4'), ('ipv6'), ('domain')) v(k) WHERE event_id % 4 <> 0)"""
register("a15_ioc_feed", _feeds, f"WITH {FEEDS} SELECT kind, entry FROM f")
register("a16_ioc_stats", lambda t: decode.ioc_stats(_feeds(t), "kind"), f"WITH {FEEDS} SELECT coalesce(kind, 'total') AS feed, count(*) AS entries FROM f GROUP BY ROLLUP (kind)")

SYSCALLS, VERBS, MOVES = ["execve", "exit", "fork"], ["connect", "bind", "accept"], ["CREATED", "UPDATED", "DELETED", "MOVED_FROM", "MOVED_TO", "OPENED", "ODD"]


def _inventory(t: DataFrame) -> DataFrame:
    """All seven tables' rows as strings, mapped; what every event has, and one field of the table's own."""
    text = lambda c: F.col(c).cast("string")
    rows = t.select(
        "event_id", F.when(F.col("event_id") % 10 > 0, text("pid")).otherwise("").alias("pid"), text("parent_pid").alias("parent"), F.col("exec_path").alias("path"), F.col("cmdline").alias("cmdline"),
        F.lit("0").alias("uid"), pick(SYSCALLS, "event_id").alias("syscall"), pick(["17", "TCP", ""], "event_id").alias("protocol"), F.lit("1").alias("protocol_num"), F.col("src_ip").alias("local_address"),
        F.lit("x").alias("local_port"), F.col("dst_ip").alias("remote_address"), F.concat(F.lit(" "), text("dst_port")).alias("remote_port"), F.col("file_path").alias("target_path"), F.lit("70000").alias("size"),
        F.lit("").alias("sha256"), F.col("src_ip").alias("address"), F.lit("70000").alias("port"), F.when(F.col("event_id") % 10 > 0, F.col("rule_uid")).alias("name"),
        pick(["Live", "Loading"], "event_id").alias("status"), pick(["0", "1"], "event_id").alias("encrypted"), F.col("file_path").alias("key_file"), pick(["ed25519", ""], "event_id").alias("algorithm"),
    )
    own = {"process_events": "pid", "socket_events": "dst_port", "file_events": "rename_to", "listening_ports": "src_port", "kernel_modules": "module", "ssh_keys": "file_type", "authorized_keys": "file_type"}
    each = []
    for table, field in own.items():
        verbs = rows.withColumn("action", pick(MOVES if table == "file_events" else VERBS, "event_id"))
        mapped = inventory.map_inventory(verbs, table)
        each.append(mapped.select(F.lit(table).alias("source"), "class_uid", F.col("activity_id").cast("int").alias("activity_id"), F.col("severity_id").cast("int").alias("severity_id"), F.col(field).cast("string").alias("own")))
    all_of = reduce(lambda a, b: a.unionByName(b), each)
    return all_of.groupBy("source", "class_uid", "activity_id", "severity_id", "own").agg(F.count(F.lit(1)).alias("n"))


register(
    "a17_map_inventory", _inventory,
    f"""WITH a AS (
SELECT 'process_events' AS source, 1007 AS class_uid, [1, 2, 99][event_id % 3 + 1] AS activity_id, 1 AS severity_id, pid::VARCHAR AS own FROM t WHERE event_id % 10 > 0
UNION ALL SELECT 'socket_events', 4001, [1, 7, 99][event_id % 3 + 1], 1, dst_port::VARCHAR FROM t
UNION ALL SELECT 'file_events', 1001, [1, 3, 4, 6, 6, 12, 99][event_id % 7 + 1], 1, CASE WHEN event_id % 7 IN (3, 4) THEN file_path ELSE '' END FROM t
UNION ALL SELECT 'listening_ports', 4001, 7, 1, '0' FROM t
UNION ALL SELECT 'kernel_modules', 1003, 1, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END, rule_uid FROM t WHERE event_id % 10 > 0
UNION ALL SELECT 'ssh_keys', 1001, 12, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END, 'ssh_private_key' FROM t
UNION ALL SELECT 'authorized_keys', 1001, 12, 1, CASE WHEN event_id % 2 = 0 THEN 'ed25519' ELSE 'authorized_key' END FROM t)
SELECT source, class_uid, CAST(activity_id AS INT) AS activity_id, CAST(severity_id AS INT) AS severity_id, own, count(*) AS n FROM a GROUP BY 1, 2, 3, 4, 5""",
)


def _polled(t: DataFrame) -> DataFrame:
    """Tables by rule with their own cursors; one row in eleven has no time that can be read."""
    rows = t.select(F.col("rule_uid").alias("table"), F.when(F.col("event_id") % 11 == 0, "soon").otherwise(F.col("event_id").cast("string")).alias("time"))
    cursors = t.where("event_id % 12 < 6").groupBy(F.col("rule_uid").alias("table")).agg(F.floor(F.max("event_id") / 2).alias("cursor"))
    fresh, after = inventory.incremental(rows, cursors)
    counts = fresh.groupBy("table").agg(F.count(F.lit(1)).alias("fresh"))
    return after.join(counts, "table", "left").select("table", "cursor", F.coalesce("fresh", F.lit(0)).alias("fresh"))


register(
    "a18_incremental", _polled,
    """WITH c AS (SELECT rule_uid, max(event_id) // 2 AS cursor FROM t WHERE event_id % 12 < 6 GROUP BY 1),
r AS (SELECT t.rule_uid, event_id FROM t LEFT JOIN c USING (rule_uid) WHERE event_id % 11 > 0 AND event_id > coalesce(cursor, 0))
SELECT rule_uid AS "table", greatest(coalesce(cursor, 0), coalesce(max(event_id), 0)) AS cursor, count(event_id) AS fresh FROM c FULL JOIN r USING (rule_uid) GROUP BY rule_uid, cursor""",
)


def _enveloped(t: DataFrame) -> DataFrame:
    e = reduce(lambda a, b: a.unionByName(b), [classes.to_envelope(classes.decode(events(t), c), F.col("host_id"), now()) for c in classes.STORED])
    return e.select("event_id", "host_id", "class_id", F.unix_millis("observed_at").alias("observed_ms"), F.get_json_object("payload", "$.metadata.uid").alias("inner_uid"))


register(
    "a20_envelope", _enveloped,
    f"SELECT {UID} AS event_id, host_id, class_uid AS class_id, CASE WHEN event_id % 3 > 0 THEN {MILLIS} ELSE epoch_ms(TIMESTAMP '2024-01-31') END AS observed_ms, {UID} AS inner_uid FROM t",
)

# C: the fields that rules name
CATEGORIES = {"process_creation": 1007, "file_event": 1001, "network_connection": 4001}


def _vocabulary(t: DataFrame) -> DataFrame:
    e = events(t)
    parts = [project_fields(classes.decode(e, c), category) for category, c in CATEGORIES.items()]
    parts[0] = project_fields(classes.decode(e, 1007), "process_creation", [*parts[0].columns[1:], "NoSuchField"])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


register(
    "c22_project_fields", _vocabulary,
    """WITH f AS (SELECT *, nullif(cmdline, '') AS c, nullif(pid, 0)::VARCHAR AS p, class_uid = 1007 AS pr, class_uid = 1001 AS fi, class_uid = 4001 AS ne FROM t WHERE class_uid <> 2004)
SELECT event_id, exec_path AS "Image", c AS "CommandLine", user_name AS "User", CASE WHEN pr THEN split_part(exec_path, '/', -1) END AS "ProcessName",
CASE WHEN NOT ne THEN p END AS "ProcessId", CASE WHEN NOT ne THEN p END AS "PID", CASE WHEN pr THEN '/sbin/init' END AS "ParentImage", CASE WHEN pr THEN 'init' END AS "ParentCommandLine",
CASE WHEN pr THEN nullif(parent_pid, 0)::VARCHAR END AS "ParentProcessId", CASE WHEN pr THEN nullif(parent_pid, 0)::VARCHAR END AS "PPID", NULL::VARCHAR AS "NoSuchField",
CASE WHEN fi THEN file_path END AS "TargetFilename", CASE WHEN fi THEN file_path END AS "Filename", CASE WHEN fi THEN file_path END AS "Path",
CASE WHEN fi AND event_id % 7 = 0 THEN file_path || '.new' END AS "RenameTo", CASE WHEN fi AND event_id % 7 = 0 THEN file_path || '.new' END AS "NewFilename",
CASE WHEN ne THEN dst_ip END AS "DestinationIp", CASE WHEN ne THEN dst_port::VARCHAR END AS "DestinationPort", CASE WHEN ne THEN src_ip END AS "SourceIp",
CASE WHEN ne THEN src_port::VARCHAR END AS "SourcePort", CASE WHEN ne THEN protocol END AS "Protocol" FROM f""",
)

# B: enrichment
KINDS = {"process": ["exec", "fork", "exit", "odd"], "file": ["open_create", "open_write", "unlink", "rename", "chmod", "chown", "odd"], "network": ["tcp_connect", "tcp_accept", "udp_send", "odd"]}


def _activities(t: DataFrame) -> DataFrame:
    each = []
    for family, kinds in KINDS.items():
        activity, code = enrich.map_activity(pick(kinds, "event_id"), family)
        each.append(t.select("event_id", F.lit(family).alias("family"), activity.alias("activity_id"), code.alias("event_code")))
    return reduce(lambda a, b: a.unionByName(b), each)


register(
    "b1_map_activity", _activities,
    """SELECT event_id, 'process' AS family, CAST([1, 1, 2, 99][event_id % 4 + 1] AS INT) AS activity_id, ['exec', 'fork', 'exit', 'unknown'][event_id % 4 + 1] AS event_code FROM t
UNION ALL SELECT event_id, 'file', [1, 3, 4, 6, 5, 7, 99][event_id % 7 + 1], ['open_create', 'open_write', 'unlink', 'rename', 'chmod', 'chown', 'unknown'][event_id % 7 + 1] FROM t
UNION ALL SELECT event_id, 'network', [1, 1, 6, 99][event_id % 4 + 1], ['tcp_connect', 'tcp_accept', 'udp_send', 'unknown'][event_id % 4 + 1] FROM t""",
)


def _network(t: DataFrame) -> DataFrame:
    raw = t.where("class_uid = 4001").withColumns({"kind": pick(KINDS["network"], "event_id"), "proto": pick([6, 17, 1, 99], "pid")})
    return enrich.normalise_net(raw).select("event_id", "direction", "protocol", "src_ip", "src_port", "dst_ip", "dst_port")


register(
    "b2_normalise_net", _network,
    """WITH a AS (SELECT *, event_id % 4 = 1 AS taken FROM t WHERE class_uid = 4001)
SELECT event_id, CAST([2, 1, 2, 0][event_id % 4 + 1] AS INT) AS direction, ['tcp', 'udp', 'icmp', ''][pid % 4 + 1] AS protocol, CASE WHEN taken THEN dst_ip ELSE src_ip END AS src_ip,
CASE WHEN taken THEN dst_port ELSE src_port END AS src_port, CASE WHEN taken THEN src_ip ELSE dst_ip END AS dst_ip, CASE WHEN taken THEN src_port ELSE dst_port END AS dst_port FROM a""",
)
register(
    "b7_parent_chain", lambda t: enrich.parent_chain(t.where("class_uid = 1007 AND pid % 10 <> 3")).select("host_id", "pid", F.transform("parents", lambda p: F.concat_ws("=", p["pid"].cast("string"), p["exec_path"])).alias("parents")),
    """WITH fs AS (SELECT host_id, pid, arg_min(parent_pid, (observed_at, event_id)) AS parent_pid, arg_min(exec_path, (observed_at, event_id)) AS exec_path FROM t WHERE class_uid = 1007 AND pid % 10 <> 3 GROUP BY 1, 2),
r AS (SELECT host_id, pid, []::VARCHAR[] AS parents, parent_pid AS next FROM fs
  UNION ALL SELECT r.host_id, r.pid, list_append(r.parents, CASE WHEN fs.pid IS NULL THEN r.next::VARCHAR ELSE r.next || '=' || fs.exec_path END), fs.parent_pid
  FROM r LEFT JOIN fs ON fs.host_id = r.host_id AND fs.pid = r.next WHERE coalesce(r.next, 0) <> 0 AND len(r.parents) < 8)
SELECT host_id, pid, arg_max(parents, len(parents)) AS parents FROM r GROUP BY 1, 2""",
)
register(
    "b13_merge", lambda t: enrich.merge(t.where("class_uid = 1007").select("event_id", "pid"), t.where("class_uid = 4001").select("event_id", "dst_ip")),
    "SELECT event_id, pid, NULL AS dst_ip FROM t WHERE class_uid = 1007 UNION ALL SELECT event_id, NULL, dst_ip FROM t WHERE class_uid = 4001",
)
