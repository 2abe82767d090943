"""Queries of predicates, rule packs and correlation, each beside its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions.predicates import all_of, any_of, in_block, ioc_match, ioc_match_any, ipv4_number, m, n_of
from sentrylake.operators import correlate, rules
from sentrylake.operators.enrich import basename
from sentrylake.plans.catalog import DAY, ORACLE, QUERIES, predicate, register
from sentrylake.plans.telemetry import TELEMETRY, oracle
from sentrylake.sources.store import shared_path
from sentrylake.streaming import stateful

# C: arrays, encodings, feeds
def people():
    return m(F.array("user_name", F.lit(""), "host_id"), many=True)


predicate("c12_multi_valued", lambda: people().equals("USER7", "host-03"), "user_name = 'user7' OR host_id = 'host-03'")
predicate("c12_multi_contains_all", lambda: people().contains("ser1", "t-0", all=True), "contains(user_name, 'ser1') AND contains(host_id, 't-0')")
predicate("c12_multi_regex", lambda: people().regex("^(user1|host-1)[0-9]$"), "regexp_matches(user_name, '^user1[0-9]$') OR regexp_matches(host_id, '^host-1[0-9]$')")
predicate("c12_multi_startswith", lambda: people().startswith("host-0", "USER9"), "starts_with(host_id, 'host-0') OR starts_with(user_name, 'user9')")
predicate("c16_base64offset", lambda: m("cmdline").contains("bin/bash", encode="base64offset_strict"), "contains(lower(cmdline), lower('Jpbi9iYXNo'))")
predicate(
    "c16_base64offset_default", lambda: m("cmdline").contains("/bin/bash -i", encode="base64offset"),
    r"contains(lower(cmdline), lower(rtrim(to_base64('/bin/bash -i'::BLOB), '='))) OR contains(lower(cmdline), lower(substr(rtrim(to_base64('\x00/bin/bash -i'::BLOB), '='), 2)))"
    r" OR contains(lower(cmdline), lower(substr(rtrim(to_base64('\x00\x00/bin/bash -i'::BLOB), '='), 3)))",
)


def wide_name() -> Column:
    """The program's name as a file with a byte order mark has it."""
    return F.concat(F.lit(b"\xff\xfe"), F.encode(basename(F.col("exec_path")), "UTF-16LE"))


predicate("c19_utf16", lambda: m(wide_name()).wide("ba", bom=True), "starts_with(split_part(exec_path, '/', -1), 'ba')")


def hidden() -> Column:
    """The command line in UTF-16, then base64, as encoded commands are passed."""
    return F.base64(F.encode("cmdline", "UTF-16LE"))


predicate("c20_utf16_base64", lambda: m(hidden()).contains("tmp", cased=True, encode="utf16le+base64offset_strict"), "contains(cmdline, 'tmp')")


def _c21(t: DataFrame) -> DataFrame:
    feed = t.select("dst_ip").distinct().where(F.conv(F.substring(F.md5("dst_ip"), 1, 4), 16, 10).cast("bigint") % 7 == 0)
    return ioc_match(t, "dst_ip", feed).select("event_id", "ioc")


register("c21_ioc", _c21, "SELECT event_id, ('0x' || substr(md5(dst_ip), 1, 4))::BIGINT % 7 = 0 AS ioc FROM t")


def _c21_kinds(t: DataFrame) -> DataFrame:
    """Feeds of addresses and of domains, over arrays of an address mapped to IPv6 and a domain with its last dot."""
    address = t.where("event_id % 5 = 0").select("dst_ip").distinct()
    domain = t.where("pid % 9 = 0").select(F.concat("user_name", F.lit(".example.org")).alias("name")).distinct()
    feeds = {"bad-ips": ("ipv4", address), "bad-names": ("domain", domain), "unused": ("ipv4", t.select("dst_ip").distinct())}
    held = t.withColumn("held", F.array(F.concat(F.lit("::FFFF:"), "dst_ip"), F.concat(F.lit(" "), F.upper("user_name"), F.lit(".example.org."))))
    both = ioc_match_any(held, "held", feeds, ["bad-ips", "bad-names", "no-such-feed"], many=True)
    none = ioc_match_any(both, "dst_ip", feeds, ["no-such-feed"], out="unknown")
    return ioc_match_any(none, "dst_ip", feeds, ["bad-ips"], out="plain").select("event_id", "ioc", "unknown", "plain")


register(
    "c21_ioc_kinds", _c21_kinds,
    """WITH a AS (SELECT DISTINCT dst_ip FROM t WHERE event_id % 5 = 0), d AS (SELECT DISTINCT user_name FROM t WHERE pid % 9 = 0)
SELECT event_id, dst_ip IN (FROM a) OR user_name IN (FROM d) AS ioc, false AS unknown, dst_ip IN (FROM a) AS plain FROM t""",
)


# R: named selections and packs
def named() -> dict[str, Column]:
    return {"sel_image": m("exec_path").endswith("/bash"), "sel_port": m("dst_port").equals(22), "other": m("protocol").equals("udp")}


FLAGS3 = "ends_with(exec_path, '/bash')", "dst_port = 22", "protocol = 'udp'"
predicate("r4_n_of", lambda: n_of(2, named()), "CAST(ends_with(exec_path, '/bash') AS INT) + CAST(dst_port = 22 AS INT) + CAST(protocol = 'udp' AS INT) >= 2")
predicate("r4_n_of_prefix", lambda: n_of(5, named(), "sel_*"), f"{FLAGS3[0]} AND {FLAGS3[1]}")
predicate("r5_all_of", lambda: all_of(named()), " AND ".join(FLAGS3))
predicate("r5_any_of", lambda: any_of(named(), "sel_*") & ~any_of(named(), "other"), f"({FLAGS3[0]} OR {FLAGS3[1]}) AND NOT ({FLAGS3[2]})")

#: What many rules of a pack test, worked out once a row of the class that has it.
SHARED = {"image_l": (1007, "exec_path", F.lower), "cmdline_l": (1007, "cmdline", F.lower), "path_l": (1001, "file_path", F.lower), "dst_n": (4001, "dst_ip", ipv4_number)}


def shared() -> dict[str, Column]:
    return {name: F.when(F.col("class_uid") == class_uid, make(F.col(source))) for name, (class_uid, source, make) in SHARED.items()}


def pack() -> list[rules.Rule]:
    """63 rules over three classes."""
    has = lambda column, text: m(column).contains(text, cased=True)  # noqa: E731  the shared columns are lower case
    ends = lambda column, text: m(column).endswith(text, cased=True)
    own = [
        rules.Rule("proc-shell", 1007, {"img": ends("image_l", "/bash"), "cmd": has("cmdline_l", "/dev/tcp/")}, lambda s: s["img"] | s["cmd"], "high", ["attack.execution", "attack.t1059.004"], "Interactive shell"),
        rules.Rule("proc-chmod", 1007, {"img": ends("image_l", "/chmod"), "cmd": has("cmdline_l", "+x")}, lambda s: s["img"] & s["cmd"], "medium", ["attack.t1222"], "File made executable"),
        rules.Rule("net-port", 4001, {"port": m("dst_port").equals(9050, 22)}, lambda s: s["port"], "critical", ["attack.t1090.003"], "Relay port"),
        rules.Rule("file-locked", 1001, {"ext": ends("path_l", ".locked")}, lambda s: s["ext"], "low", ["attack.t1486"], "Encrypted file"),
        rules.Rule("odd-level", 1001, {"dir": m("path_l").startswith("/var/view/f1", cased=True)}, lambda s: s["dir"], "loud", [], ""),
    ]
    nets = [rules.Rule(f"net-dst-{k}", 4001, {"ip": in_block(F.col("dst_n"), f"10.{k}.0.0/16")}, lambda s: s["ip"], "informational") for k in range(8)]
    users = [rules.Rule(f"proc-user-{k}", 1007, {"u": m("user_name").endswith(str(k), cased=True), "v": has("cmdline_l", "tmp")}, lambda s: s["u"] & ~s["v"], "low") for k in range(10)]
    paths = [rules.Rule(f"file-f{k}", 1001, {"p": has("path_l", f"/f{k}.")}, lambda s: s["p"], "medium") for k in range(20)]
    ports = [rules.Rule(f"net-src-{k}", 4001, {"p": m("src_port").compare("gte", 1024 + 500 * k), "q": m("src_port").compare("lt", 1074 + 500 * k)}, lambda s: s["p"] & s["q"], "high") for k in range(20)]
    return own + nets + users + paths + ports


HITS = """h AS (
  SELECT event_id, 'proc-shell' AS rule, 4 AS severity FROM t WHERE class_uid = 1007 AND (ends_with(exec_path, '/bash') OR coalesce(contains(cmdline, '/dev/tcp/'), false))
  UNION ALL SELECT event_id, 'proc-chmod', 3 FROM t WHERE class_uid = 1007 AND ends_with(exec_path, '/chmod') AND contains(cmdline, '+x')
  UNION ALL SELECT event_id, 'net-port', 5 FROM t WHERE class_uid = 4001 AND dst_port IN (9050, 22)
  UNION ALL SELECT event_id, 'file-locked', 2 FROM t WHERE class_uid = 1001 AND ends_with(file_path, '.LOCKED')
  UNION ALL SELECT event_id, 'odd-level', 3 FROM t WHERE class_uid = 1001 AND starts_with(file_path, '/var/view/f1')
  UNION ALL SELECT event_id, 'net-dst-' || split_part(dst_ip, '.', 2), 1 FROM t WHERE class_uid = 4001
  UNION ALL SELECT event_id, 'proc-user-' || right(user_name, 1), 2 FROM t WHERE class_uid = 1007 AND NOT coalesce(contains(cmdline, 'tmp'), false)
  UNION ALL SELECT event_id, 'file-f' || event_id % 50, 3 FROM t WHERE class_uid = 1001 AND event_id % 50 < 20
  UNION ALL SELECT event_id, 'net-src-' || (src_port - 1024) // 500, 4 FROM t WHERE class_uid = 4001 AND src_port - 1024 < 10000 AND (src_port - 1024) % 500 < 50)"""
register("r7_rule_pack", lambda t: rules.detect(t, pack(), ["event_id"], shared()), f"WITH {HITS} SELECT event_id, rule, severity FROM h")
register(
    "r8_findings", lambda t: rules.to_findings(rules.detect(t, pack(), ["event_id"], shared(), chunk=20), pack()),
    f"""WITH {HITS} SELECT sha256(rule || ',' || event_id) AS finding_uid, rule, severity, 200401 AS type_uid, 'New' AS status, [event_id] AS event_ids,
CASE rule WHEN 'proc-shell' THEN 'Interactive shell' WHEN 'proc-chmod' THEN 'File made executable' WHEN 'net-port' THEN 'Relay port' WHEN 'file-locked' THEN 'Encrypted file' ELSE rule END AS title,
CASE rule WHEN 'proc-shell' THEN ['T1059.004'] WHEN 'proc-chmod' THEN ['T1222'] WHEN 'net-port' THEN ['T1090.003'] WHEN 'file-locked' THEN ['T1486'] ELSE []::VARCHAR[] END AS techniques FROM h""",
)


def _rules(t: DataFrame) -> DataFrame:
    n = F.substring("uid", -2, 2).cast("int")
    source = F.concat(F.lit("tags: [Attack.T10"), F.lpad((n * 7 % 12).cast("string"), 2, "0"), F.lit(".001]"))
    each = t.groupBy(F.col("rule_uid").alias("uid")).agg(F.max("observed_at").alias("updated_at"))
    return each.withColumns({"name": F.concat(F.lit("Rule "), "uid"), "enabled": n % 4 != 3, "source": source})


register(
    "r10_list_rules", lambda t: rules.list_rules(_rules(t), "2024-01-01 00:00:00", "t100").unionByName(rules.list_rules(_rules(t), "2124-01-01 00:00:00")),
    """SELECT rule_uid AS uid, 'Rule ' || rule_uid AS name, max(observed_at) AS updated_at FROM t WHERE substr(rule_uid, -2)::INT % 4 <> 3 AND substr(rule_uid, -2)::INT * 7 % 12 < 10
GROUP BY 1 HAVING max(observed_at) >= TIMESTAMP '2024-01-01'""",
)


def _levels(t: DataFrame) -> DataFrame:
    names = ["informational", "LOW", "medium", "high", "critical", "shrill", ""]
    each = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(rules.severity(n)).alias("severity")) for n in names])
    return t.select("event_id", F.explode(each).alias("x")).groupBy("x.level", "x.severity").agg(F.count(F.lit(1)).alias("n"))


register(
    "r11_severity", _levels,
    "SELECT v.l AS level, v.s AS severity, count(*) AS n FROM t, (VALUES ('informational', 1), ('LOW', 2), ('medium', 3), ('high', 4), ('critical', 5), ('shrill', 3), ('', 3)) v(l, s) GROUP BY 1, 2",
)


# D: warm start, arrival order, streams
def starts() -> Column:
    return (F.col("class_uid") == 1007) & m("exec_path").endswith("/bash", "/sudo")


SINCE = "2024-01-15 00:00:00"
PROC = "class_uid = 1007 AND (ends_with(exec_path, '/bash') OR ends_with(exec_path, '/sudo'))"


def _warm(t: DataFrame) -> DataFrame:
    live, history = t.where(F.col("observed_at") >= F.lit(SINCE).cast("timestamp_ntz")), t.where(F.col("observed_at") < F.lit(SINCE).cast("timestamp_ntz"))
    warm = correlate.count_over_warm(live, history, starts(), ["user_name"], DAY, ">", 1, max_lookback_s=DAY).select("event_id", "n_hits", F.lit("warm").alias("start"))
    cold = correlate.count_over_warm(live, history, starts(), ["user_name"], DAY, ">", 1, max_lookback_s=3600).select("event_id", "n_hits", F.lit("cold").alias("start"))
    return warm.unionByName(cold)


register(
    "d10_warm_start", _warm,
    f"""WITH c AS (SELECT *, epoch_us(observed_at) AS us, observed_at >= TIMESTAMP '{SINCE}' AS live FROM t WHERE {PROC}),
w AS (SELECT event_id, live, count(*) OVER f AS warm, count(*) FILTER (WHERE live) OVER f AS cold FROM c WINDOW f AS (PARTITION BY user_name ORDER BY us RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW))
SELECT event_id, warm AS n_hits, 'warm' AS start FROM w WHERE live AND warm > 1 UNION ALL SELECT event_id, cold, 'cold' FROM w WHERE live AND cold > 1""",
)
register(
    "d1_arrival_order", lambda t: correlate.count_over(t.withColumn("observed_at", F.date_trunc("day", "observed_at")), starts(), ["user_name"], 2 * DAY, ">=", 2, detail=False, ties="arrival").select("event_id", "n_hits"),
    f"""WITH c AS (SELECT event_id, user_name, epoch_us(date_trunc('day', observed_at)) AS us FROM t WHERE {PROC})
SELECT a.event_id, count(*) AS n_hits FROM c a JOIN c b ON a.user_name = b.user_name AND b.us >= a.us - {2 * DAY}000000 AND (b.us < a.us OR (b.us = a.us AND b.event_id <= a.event_id))
GROUP BY a.event_id HAVING count(*) >= 2""",
)


def streamed(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """The rows that a streaming query over the events table, read as a stream of files, writes until it has read all."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = shared_path(spark, "stream")
    table.write.parquet(f"{at}/in")
    out = build(stream_view(spark, spark.readStream.schema(table.schema).parquet(f"{at}/in")))
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def stream_view(spark: SparkSession, stream: DataFrame) -> DataFrame:
    return spark.sql(TELEMETRY.replace("{source}", "{events}"), events=stream)


QUERIES["d11_stream_count"] = lambda spark, sf_dir: streamed(spark, sf_dir, lambda t: stateful.stream_count_over(t.where(starts()), "user_name", DAY, 1)).select("event_id", F.col("n_hits").cast("bigint").alias("n_hits"))
ORACLE["d11_stream_count"] = oracle(
    f"""WITH c AS (SELECT *, epoch_us(observed_at) AS us FROM t WHERE {PROC}),
w AS (SELECT event_id, count(*) OVER (PARTITION BY user_name ORDER BY us RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW) AS n_hits FROM c) SELECT event_id, n_hits FROM w WHERE n_hits > 1"""
)
QUERIES["f14_live_tail"] = lambda spark, sf_dir: streamed(
    spark, sf_dir, lambda t: stateful.live_tail(t, "HOST-0", 1007, ": 4", "10 days", now=F.lit("2024-01-31 00:00:00").cast("timestamp")).select("event_id", "host_id")
)
ORACLE["f14_live_tail"] = oracle(
    "SELECT event_id, host_id FROM t WHERE contains(host_id, 'host-0') AND class_uid = 1007 AND contains(raw, ': 4') AND observed_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY"
)
