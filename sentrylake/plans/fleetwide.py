"""Queries of fleet health, chains, load levels and hunts, each beside its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrylake.operators import fleet
from sentrylake.plans.catalog import DAY, ORACLE, QUERIES, pick, register
from sentrylake.plans.lookups import ALERTS, host_table


def _statuses(t: DataFrame) -> DataFrame:
    """Hosts at a time 45 seconds after the last event of the fleet, moved so that every status occurs."""
    n = F.substring("host_id", 6, 2).cast("int")
    seen = t.groupBy("host_id").agg(F.max("observed_at").alias("own"))
    last = t.agg(F.max("observed_at").alias("last"))
    shifted = F.when(n % 5 == 0, F.col("last") + F.expr("INTERVAL 20 SECONDS")).when(n % 5 == 1, F.col("last")).when(n % 5 < 4, F.col("own"))
    # the fleet's last time is one row
    both = seen.join(F.broadcast(last.withColumn("one", F.lit(1))), F.col("one") == F.lit(1))
    return both.select("host_id", fleet.host_status(shifted, n == 3, F.col("last") + F.expr("INTERVAL 45 SECONDS")).alias("status"))


register(
    "h1_host_status", _statuses,
    """WITH l AS (SELECT max(observed_at) AS last FROM t), s AS (SELECT host_id, max(observed_at) AS own, substr(host_id, 6, 2)::INT AS n FROM t GROUP BY 1),
a AS (SELECT host_id, n, last, CASE WHEN n % 5 = 0 THEN last + INTERVAL 20 SECOND WHEN n % 5 = 1 THEN last WHEN n % 5 < 4 THEN own END AS seen FROM s, l),
g AS (SELECT *, epoch_us(last) + 45000000 - epoch_us(seen) AS age FROM a)
SELECT host_id, CASE WHEN n = 3 THEN 'revoked' WHEN seen IS NULL THEN 'unknown' WHEN age < 30000000 THEN 'online' WHEN age < 90000000 THEN 'stale' ELSE 'offline' END AS status FROM g""",
)
register(
    "h2_heartbeats",
    lambda t: fleet.apply_heartbeats(
        host_table(t).where("host_id <> 'host-04'").select("host_id", F.col("enrolled_at").alias("last_seen"), "agent_version"),
        t.where("host_id <> 'host-02' AND event_id % 3 = 0").select("host_id", F.col("observed_at").alias("at"), F.when((F.col("event_id") % 2 == 0) & (F.col("host_id") != "host-06"), F.concat(F.lit("2."), F.col("event_id").cast("string"))).otherwise("").alias("agent_version")),
    ),
    f"""WITH {ALERTS}, b AS (SELECT host_id, observed_at AS seen_at, CASE WHEN event_id % 2 = 0 AND host_id <> 'host-06' THEN '2.' || event_id ELSE '' END AS v FROM t WHERE host_id <> 'host-02' AND event_id % 3 = 0),
s AS (SELECT host_id, max(seen_at) AS latest, arg_max(v, (seen_at, v)) FILTER (WHERE v <> '') AS ver FROM b GROUP BY 1)
SELECT host_id, greatest(enrolled_at, coalesce(latest, enrolled_at)) AS last_seen, coalesce(ver, '1.0') AS agent_version FROM hs LEFT JOIN s USING (host_id) WHERE host_id <> 'host-04'""",
)
register("h3_hosts", lambda t: fleet.list_hosts(host_table(t)).select("host_id", "hostname", "active"), f"WITH {ALERTS} SELECT host_id, hostname, revoked_at IS NULL AS active FROM hs")
register("h12_hunt_hosts", lambda t: fleet.hunt_hosts(host_table(t), "BOX-1").unionByName(fleet.hunt_hosts(host_table(t), "t-1")), f"WITH {ALERTS} SELECT host_id, hostname FROM hs WHERE revoked_at IS NULL AND contains(lower(hostname), 'box-1') UNION ALL SELECT host_id, hostname FROM hs WHERE revoked_at IS NULL AND contains(host_id, 't-1')")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a chain, folded record by record, as a record's hash holds the one before; some are tampered with:
    by conversation, numbers skip, a prev_hash or a summary is changed."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("kind"), F.md5(F.coalesce("text", F.lit(""))).alias("summary"))
    turns = c.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("all"))
    ts = lambda seq: F.concat(F.lit("2024-01-01T00:"), F.lpad((seq % 60).cast("string"), 2, "0"), F.lit(":00Z"))

    def step(state, x):
        seq = F.size(state["out"]).cast("bigint")
        kind = F.when(seq == 0, "chain.init").otherwise(x["kind"])
        made = fleet.record_hash(seq, ts(seq), kind, x["summary"], state["prev"])
        record = F.struct(seq.alias("seq"), ts(seq).alias("ts"), kind.alias("kind"), x["summary"].alias("summary"), state["prev"].alias("prev_hash"), made.alias("record_hash"))
        return F.struct(made.alias("prev"), F.concat(state["out"], F.array(record)).alias("out"))

    empty = F.array().cast("array<struct<seq: bigint, ts: string, kind: string, summary: string, prev_hash: string, record_hash: string>>")
    folded = turns.select(F.col("conv_id").alias("host_id"), F.explode(F.aggregate("all", F.struct(F.lit(fleet.ZERO_HASH).alias("prev"), empty.alias("out")), step)["out"]).alias("r")).select("host_id", "r.*")
    k, later = F.col("host_id") % 7, F.col("seq") >= 2
    return folded.withColumns({
        "seq": F.when((k == 1) & later, F.col("seq") + 1).otherwise(F.col("seq")),
        "prev_hash": F.when((k == 2) & (F.col("seq") == 1), F.lit("x")).otherwise(F.col("prev_hash")),
        "summary": F.when((k == 3) & (F.col("seq") == 1), F.lit("changed")).otherwise(F.col("summary")),
    })


#: c: the same records in DuckDB.
CHAINS = """WITH RECURSIVE n AS (SELECT conv_id AS host_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS seq, coalesce(role, '') AS kind, md5(coalesce(text, '')) AS summary FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT host_id, seq, '2024-01-01T00:' || lpad((seq % 60)::VARCHAR, 2, '0') || ':00Z' AS ts, CASE WHEN seq = 0 THEN 'chain.init' ELSE kind END AS kind, summary FROM n),
f AS (SELECT m.*, repeat('0', 64) AS prev_hash, sha256(concat_ws('|', seq, ts, kind, summary, repeat('0', 64))) AS record_hash FROM m WHERE seq = 0
  UNION ALL SELECT m.*, f.record_hash, sha256(concat_ws('|', m.seq, m.ts, m.kind, m.summary, f.record_hash)) FROM f JOIN m ON m.host_id = f.host_id AND m.seq = f.seq + 1),
c AS (SELECT host_id, CASE WHEN host_id % 7 = 1 AND seq >= 2 THEN seq + 1 ELSE seq END AS seq, ts, kind, CASE WHEN host_id % 7 = 3 AND seq = 1 THEN 'changed' ELSE summary END AS summary,
  CASE WHEN host_id % 7 = 2 AND seq = 1 THEN 'x' ELSE prev_hash END AS prev_hash, record_hash FROM f)"""
SINCE = "2024-01-01T00:02:00Z"
QUERIES["h4_verify_chain"] = lambda spark, sf_dir: fleet.verify_chain(chains(spark, sf_dir), since=F.lit(SINCE))
ORACLE["h4_verify_chain"] = f"""{CHAINS},
p AS (SELECT *, coalesce(lag(record_hash) OVER w, repeat('0', 64)) AS before, row_number() OVER w - 1 AS k FROM c WINDOW w AS (PARTITION BY host_id ORDER BY seq)),
r AS (SELECT *, CASE WHEN seq <> k THEN 'sequence gap' WHEN prev_hash <> before THEN 'prev_hash mismatch' WHEN record_hash <> sha256(concat_ws('|', seq, ts, kind, summary, prev_hash)) THEN 'record_hash mismatch' END AS reason FROM p),
b AS (SELECT host_id, count(*) AS records, min(seq) FILTER (WHERE reason IS NOT NULL) AS broken_at, coalesce(arg_min(reason, seq) FILTER (WHERE reason IS NOT NULL), 'ok') AS verdict FROM r GROUP BY 1)
SELECT b.*, (SELECT count(*) FROM c WHERE c.host_id = b.host_id AND c.ts >= '{SINCE}' AND (b.broken_at IS NULL OR c.seq < b.broken_at)) AS walked FROM b"""
QUERIES["h5_chain_summaries"] = lambda spark, sf_dir: fleet.chain_summaries(chains(spark, sf_dir), "2 minutes").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since_at", "until_at")})
ORACLE["h5_chain_summaries"] = f"""{CHAINS}
SELECT host_id, time_bucket(INTERVAL 2 MINUTE, strptime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS since_at, time_bucket(INTERVAL 2 MINUTE, strptime(ts, '%Y-%m-%dT%H:%M:%SZ')) + INTERVAL 2 MINUTE AS until_at,
max(seq) AS last_seq, arg_max(record_hash, seq) AS last_hash, count(*) FILTER (WHERE kind <> 'chain.init') AS count_observed FROM c GROUP BY 1, 2, 3"""


def _summaries(t: DataFrame) -> DataFrame:
    rows = t.select("host_id", F.col("event_id").alias("id"), F.col("observed_at").alias("received_at"), (F.col("event_id") % 5 == 0).alias("mismatch"))
    newest = fleet.list_summaries(rows, 3).withColumn("kind", F.lit("all"))
    return newest.unionByName(fleet.list_summaries(rows, 2, only_mismatch=True).withColumn("kind", F.lit("mismatch"))).select("host_id", "id", "rank", "kind")


register(
    "h7_list_summaries", _summaries,
    """WITH w AS (SELECT host_id, event_id AS id, CAST(row_number() OVER (PARTITION BY host_id ORDER BY observed_at DESC, event_id DESC) AS INT) AS rank, 'all' AS kind FROM t
UNION ALL SELECT host_id, event_id, row_number() OVER (PARTITION BY host_id ORDER BY observed_at DESC, event_id DESC), 'mismatch' FROM t WHERE event_id % 5 = 0)
SELECT * FROM w WHERE rank <= CASE kind WHEN 'all' THEN 3 ELSE 2 END""",
)


def counters(t: DataFrame) -> DataFrame:
    """Running counters of a host by day; on some days many drops, on some none, on some no events."""
    day = F.date_trunc("day", "observed_at")
    daily = t.groupBy("host_id", day.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    k = F.dayofmonth("at") % 4
    daily = daily.withColumns({"e": F.when(k == 3, 0).otherwise(F.col("n") * 100), "d": F.when(k == 1, F.col("n") * 10).when(k == 2, F.col("n")).otherwise(0)})
    w = Window.partitionBy("host_id").orderBy("at")
    return daily.select("host_id", "at", F.sum("e").over(w).alias("events"), F.sum("d").over(w).alias("drops"))


register(
    "h8_load_level", lambda t: fleet.level_changes(counters(t)).select("host_id", "at", "level"),
    """SELECT host_id, date_trunc('day', observed_at)::TIMESTAMP AS at, CASE day(min(observed_at)) % 4 WHEN 1 THEN 'critical' WHEN 2 THEN 'elevated' ELSE 'normal' END AS level FROM t GROUP BY 1, 2""",
)


def _merged(t: DataFrame) -> DataFrame:
    signals = t.where("event_id % 4 < 2").select("host_id", pick(["server", "self"], "event_id").alias("source"), pick([*fleet.LEVELS, "odd"], "pid").alias("level"), F.col("observed_at").alias("since"), "event_id")
    return fleet.merge_levels(signals, F.lit("2024-01-25 00:00:00").cast("timestamp"), ttl_s=3 * DAY)


register(
    "h9_merge_levels", _merged,
    f"""WITH s AS (SELECT host_id, ['server', 'self'][event_id % 2 + 1] AS source, arg_max([0, 1, 2, 0][pid % 4 + 1], observed_at) AS r, max(observed_at) AS since FROM t WHERE event_id % 4 < 2 GROUP BY 1, 2)
SELECT host_id, ['normal', 'elevated', 'critical'][max(CASE WHEN epoch_us(TIMESTAMP '2024-01-25') - epoch_us(since) > {3 * DAY}000000 THEN 0 ELSE r END) + 1] AS level FROM s GROUP BY 1""",
)
register(
    "h11_drop_rate",
    lambda t: fleet.drop_rate(t.select(F.concat(F.lit("stage-"), (F.col("class_uid") % 7).cast("string")).alias("stage"), F.when(F.col("class_uid") != 2004, F.col("pid")).otherwise(0).alias("produced"), F.when(F.col("event_id") % 50 == 0, F.when(F.col("class_uid") != 2004, 3).otherwise(0)).otherwise(0).alias("dropped"))).select("stage", "dropped", F.round("rate", 9).alias("rate")),
    """WITH a AS (SELECT 'stage-' || class_uid % 7 AS stage, CASE WHEN class_uid <> 2004 THEN pid ELSE 0 END AS p, CASE WHEN event_id % 50 = 0 AND class_uid <> 2004 THEN 3 ELSE 0 END AS d FROM t)
SELECT stage, sum(d)::BIGINT AS dropped, round(CASE WHEN sum(p) + sum(d) = 0 THEN 0 ELSE sum(d) / (sum(p) + sum(d)) END, 9) AS rate FROM a GROUP BY 1""",
)


def results(t: DataFrame) -> DataFrame:
    names = F.array(F.lit("event"), F.lit("pid"))
    values = F.when(F.col("event_id") % 3 == 0, F.array(F.col("event_id").cast("string"))).otherwise(F.array(F.col("event_id").cast("string"), F.col("pid").cast("string")))
    return t.select(F.col("rule_uid").alias("query_id"), "host_id", "observed_at", names.alias("columns"), values.alias("values"))


register("h14_hunt_counts", lambda t: fleet.hunt_counts(results(t)), "SELECT rule_uid AS query_id, host_id, count(*) AS n FROM t GROUP BY 1, 2")
register(
    "h14_hunt_rows", lambda t: fleet.hunt_rows(results(t), 40, 60).select("query_id", "host_id", "observed_at", F.col("row")["event"].alias("event"), F.col("row")["pid"].alias("pid")),
    """SELECT rule_uid AS query_id, host_id, observed_at, event_id::VARCHAR AS event, CASE WHEN event_id % 3 = 0 THEN '' ELSE pid::VARCHAR END AS pid FROM t
ORDER BY t.observed_at, t.host_id, t.rule_uid LIMIT 40 OFFSET 60""",
)
