"""Event classes: payload schemas, decoding, flattening to hot columns, validation, envelopes and class tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.sources.decode import NIL_UUID, canonical_uuid

#: Class numbers and the names of the classes that are stored.
STORED = {1001: "file", 1007: "process", 2004: "finding", 4001: "network"}

# Field names of the payloads; some hold dots.
USER = "STRUCT<name: STRING, uid: STRING, type: STRING>"
FILE = "STRUCT<name: STRING, path: STRING, type: STRING, size: BIGINT, `hashes.sha256`: STRING>"
ENDPOINT = "STRUCT<ip: STRING, port: INT>"
HEAD = (
    "metadata STRUCT<uid: STRING, version: STRING, original_time: BIGINT, event_code: STRING, labels: ARRAY<STRING>, correlation_uid: STRING>, "
    "class_uid INT, activity_id INT, type_uid BIGINT, severity_id INT, time BIGINT, device STRUCT<uid: STRING, hostname: STRING>"
)


def process_type(depth: int = 8) -> str:
    """A process with its ancestors, `depth` levels."""
    parent = f", parent_process: {process_type(depth - 1)}" if depth > 1 else ""
    return f"STRUCT<pid: BIGINT, uid: STRING, name: STRING, cmd_line: STRING, file: {FILE}, user: {USER}{parent}>"


ACTOR = f"actor STRUCT<process: {process_type(2)}, user: {USER}>"
TECHNIQUE = "STRUCT<uid: STRING, name: STRING>"
BODY = {
    1001: f"{ACTOR}, file {FILE}, file_diff {FILE}",
    1003: f"{ACTOR}, kernel STRUCT<name: STRING, type: STRING, path: STRING>",
    1007: f"{ACTOR}, process {process_type()}, exit_code INT",
    2004: "finding STRUCT<uid: STRING, title: STRING, status: STRING>, rule STRUCT<uid: STRING, name: STRING>, "
    f"attacks ARRAY<STRUCT<technique: {TECHNIQUE}, sub_technique: {TECHNIQUE}>>, x_triggering_event_ids ARRAY<STRING>",
    3002: f"{ACTOR}, user {USER}, status STRING",
    4001: f"{ACTOR}, connection_info STRUCT<protocol_name: STRING, direction: STRING>, src_endpoint {ENDPOINT}, dst_endpoint {ENDPOINT}",
    4003: f"{ACTOR}, query STRUCT<hostname: STRING, type: STRING>",
    6000: f"{ACTOR}, container STRUCT<uid: STRING, name: STRING>",
}


def decode(df: DataFrame, class_uid: int, payload: str = "payload") -> DataFrame:
    """Envelopes of one class with their payload as struct `p`; empty payloads and those that can't be decoded go.

    The payload is read in an explode, as tests of `p` would be pushed below a plain column and read it again for each.
    """
    schema = f"{HEAD}, {BODY[class_uid]}, _corrupt STRING"
    read = F.from_json(payload, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    own = df.where(F.col("class_uid") == class_uid).drop("p").withColumn("p", F.explode(F.array(read)))
    return own.where("p is not null and p._corrupt is null").withColumn("p", F.col("p").dropFields("_corrupt"))


def split_by_class(df: DataFrame) -> tuple[dict[int, DataFrame], DataFrame]:
    """Class tables of a mixed stream, by class number, and the rows of unknown classes, which are dropped and counted."""
    known = F.coalesce(F.col("class_uid").isin(*STORED), F.lit(False))
    return {c: df.where(F.col("class_uid") == c) for c in STORED}, df.where(~known)


def _hot(df: DataFrame, extra: dict[str, Column] | None = None, **columns: str) -> DataFrame:
    own = [F.col(f"p.{path}").alias(name) for name, path in columns.items()]
    return df.select("event_id", "host_id", F.col("p.activity_id").alias("activity_id"), *own, *[c.alias(n) for n, c in (extra or {}).items()])


def flatten_process(df: DataFrame) -> DataFrame:
    return _hot(
        df, pid="process.pid", parent_pid="process.parent_process.pid", process_name="process.name", exec_path="process.file.path",
        cmdline="process.cmd_line", user_name="process.user.name", exit_code="exit_code",
    )


def flatten_file(df: DataFrame) -> DataFrame:
    return _hot(df, file_path="file.path", file_name="file.name", file_hash_sha256="file.`hashes.sha256`", actor_pid="actor.process.pid", actor_name="actor.process.name")


def flatten_network(df: DataFrame) -> DataFrame:
    return _hot(
        df, protocol="connection_info.protocol_name", src_ip="src_endpoint.ip", src_port="src_endpoint.port", dst_ip="dst_endpoint.ip",
        dst_port="dst_endpoint.port", actor_pid="actor.process.pid", actor_name="actor.process.name",
    )


def flatten_finding(df: DataFrame) -> DataFrame:
    """Event ids that are no UUID are skipped; techniques stand beside their sub-techniques, empty and double ones not."""
    ids = F.filter(F.transform("p.x_triggering_event_ids", canonical_uuid), lambda x: x != NIL_UUID)

    def named(a: Column) -> Column:
        own, sub = F.coalesce(a["technique"]["uid"], F.lit("")), F.coalesce(a["sub_technique"]["uid"], F.lit(""))
        return F.array(own, F.when(sub != own, sub).otherwise(F.lit("")))

    techniques = F.filter(F.flatten(F.transform("p.attacks", named)), lambda x: x != "")
    none = F.array().cast("array<string>")
    lists = {"triggering_event_ids": F.coalesce(ids, none), "mitre_techniques": F.coalesce(techniques, none)}
    return _hot(df, lists, rule_uid="rule.uid", rule_name="rule.name", finding_uid="finding.uid", finding_status="finding.status")


def _lacks(*paths: str) -> Column:
    """None of the paths has a value; empty text and 0 are none."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f"p.{x}").cast("string"), F.lit("")).isin("", "0") for x in paths])


#: What an event of each class must have, besides its class, an activity and a time; in this order.
REQUIRED = {
    1001: [(lambda: _lacks("file.path", "file.name"), "file.path or file.name required"), (lambda: (F.col("p.activity_id") == 6) & F.col("p.file_diff").isNull(), "rename requires file_diff target")],
    1003: [(lambda: _lacks("kernel.name"), "kernel.name required")],
    1007: [(lambda: _lacks("process.pid"), "process.pid required"), (lambda: _lacks("device.uid"), "device.uid required")],
    2004: [
        (lambda: _lacks("finding.uid"), "finding.uid required"),
        (lambda: _lacks("rule.uid"), "rule.uid required"),
        (lambda: F.coalesce(F.size("p.x_triggering_event_ids"), F.lit(0)) <= 0, "at least one triggering event id required"),
    ],
    3002: [(lambda: _lacks("user.name", "user.uid"), "user.name or user.uid required")],
    4001: [(lambda: _lacks("connection_info.protocol_name"), "connection_info.protocol_name required")],
    4003: [(lambda: _lacks("query.hostname"), "query.hostname required")],
    6000: [(lambda: _lacks("container.uid", "container.name"), "container.uid or container.name required")],
}


def validate(df: DataFrame, class_uid: int) -> DataFrame:
    """Decoded events with `error`: the first rule of their class that fails, null if none does."""
    wrong = ~F.col("p.class_uid").eqNullSafe(F.lit(class_uid))
    error = F.when(wrong, F.lit("class_uid")).when(_lacks("activity_id"), "activity_id required").when(_lacks("time"), "time required")
    for test, text in REQUIRED[class_uid]:
        error = error.when(test(), text)
    return df.withColumn("error", error)


def to_envelope(events: DataFrame, host_id: Column, now: Column, payload: str = "payload") -> DataFrame:
    """Envelopes of events that are structs in `p`: observed at the payload's original time in ms, or now without one."""
    at = F.coalesce(F.col("p.metadata.original_time"), F.lit(0))
    observed = F.when(at == 0, now.cast("timestamp")).otherwise(F.timestamp_millis(at))
    return events.select(
        F.col("p.metadata.uid").alias("event_id"), host_id.alias("host_id"), F.col("p.class_uid").alias("class_id"),
        observed.alias("observed_at"), now.cast("timestamp").alias("collected_at"), F.to_json("p").alias(payload),
    )


def scan(tables: dict[int, DataFrame], classes: list[int] | None = None) -> DataFrame:
    """The union of the class tables asked for; none asked for means all, unknown and double ones don't count."""
    asked = [c for c in dict.fromkeys(classes or tables) if c in tables]
    if not asked:
        return next(iter(tables.values())).limit(0)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tables[c] for c in asked])
