"""Inventory rows, all strings, as events; and polls that take only what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def whole_number(text: Column, bits: int) -> Column:
    """An unsigned decimal of at most `bits` bits; anything else is 0."""
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike("^[0-9]{1,20}$"), trimmed.try_cast("decimal(20,0)"))
    return F.coalesce(F.when(number < F.lit(str(2**bits)).cast("decimal(20,0)"), number), F.lit(0)).cast("bigint")


def _chosen(of: Column, values: dict[str, str | int], other) -> Column:
    out = F.lit(other)
    for key, value in values.items():
        out = F.when(of == key, F.lit(value)).otherwise(out)
    return out


PROTOCOLS = {"6": "tcp", "17": "udp", "1": "icmp"}  # fixed values


def map_inventory(df: DataFrame, table: str) -> DataFrame:
    """Events of an inventory table's rows: class_uid, activity_id, severity_id and the fields that the table fills.

    Rows without the table's required field go. Numbers that can't be read are 0. A moved file has its own path as the
    rename's target, on either side of the move.
    """
    # fixed values: classes, required fields, activities by verb
    if table == "process_events":
        activity = _chosen(_text("syscall"), {"execve": 1, "execveat": 1, "exit": 2, "exit_group": 2}, 99)
        fields = {"pid": whole_number(F.col("pid"), 32), "parent_pid": whole_number(F.col("parent"), 32), "exec_path": _text("path"), "cmdline": _text("cmdline"), "uid": _text("uid")}
        return _events(df, 1007, "pid", activity, F.lit(1), fields)
    if table == "socket_events":
        verb, named = _text("action"), F.lower(_text("protocol"))
        spoken = F.when(named == "", _chosen(_text("protocol_num"), PROTOCOLS, "")).when(named.isin(*PROTOCOLS), _chosen(named, PROTOCOLS, "")).otherwise(named)
        fields = {
            "protocol": spoken, "direction": F.when(verb == "bind", "inbound").otherwise("outbound"), "src_ip": _text("local_address"), "src_port": whole_number(F.col("local_port"), 16),
            "dst_ip": _text("remote_address"), "dst_port": whole_number(F.col("remote_port"), 16), "pid": whole_number(F.col("pid"), 32), "exec_path": _text("path"), "uid": _text("uid"),
        }
        return _events(df, 4001, None, _chosen(verb, {"connect": 1, "bind": 7}, 99), F.lit(1), fields)
    if table == "file_events":
        verb = _text("action")
        activity = _chosen(verb, {"CREATED": 1, "ADDED": 1, "UPDATED": 3, "ATTRIBUTES_MODIFIED": 3, "DELETED": 4, "MOVED_FROM": 6, "MOVED_TO": 6, "OPENED": 12}, 99)
        target = F.when(verb.isin("MOVED_FROM", "MOVED_TO"), _text("target_path")).otherwise("")
        fields = {"file_path": _text("target_path"), "rename_to": target, "size": whole_number(F.col("size"), 63), "sha256": _text("sha256"), "uid": _text("uid")}
        return _events(df, 1001, "target_path", activity, F.lit(1), fields)
    if table == "listening_ports":
        spoken = _chosen(F.lower(_text("protocol")), {"17": "udp", "udp": "udp", "1": "icmp", "icmp": "icmp"}, "tcp")
        fields = {"protocol": spoken, "direction": F.lit("inbound"), "src_ip": _text("address"), "src_port": whole_number(F.col("port"), 16), "pid": whole_number(F.col("pid"), 32), "exec_path": _text("path")}
        return _events(df, 4001, None, F.lit(7), F.lit(1), fields)
    if table == "kernel_modules":
        return _events(df, 1003, "name", F.lit(1), F.when(_text("status").isin("", "Live"), 1).otherwise(2), {"module": _text("name")})
    if table == "ssh_keys":
        return _events(df, 1001, "path", F.lit(12), F.when(_text("encrypted") == "0", 2).otherwise(1), {"file_path": _text("path"), "file_type": F.lit("ssh_private_key"), "uid": _text("uid")})
    if table == "authorized_keys":
        kind = F.when(_text("algorithm") == "", "authorized_key").otherwise(F.col("algorithm"))
        return _events(df, 1001, "key_file", F.lit(12), F.lit(1), {"file_path": _text("key_file"), "file_type": kind, "uid": _text("uid")})
    raise ValueError(f"unknown inventory table {table}")


def _events(df: DataFrame, class_uid: int, required: str | None, activity: Column, severity: Column, fields: dict[str, Column]) -> DataFrame:
    kept = df if required is None else df.where(F.trim(_text(required)) != "")
    head = {"class_uid": F.lit(class_uid), "activity_id": activity, "severity_id": severity}
    return kept.select(*df.columns[:1], *[c.alias(n) for n, c in (head | fields).items()])


def incremental(df: DataFrame, cursors: DataFrame, table: str = "table", time: str = "time") -> tuple[DataFrame, DataFrame]:
    """Rows newer than their table's cursor, and the cursors after them (the latest time seen; times that can't be read don't count)."""
    at = whole_number(F.col(time), 63)
    held = cursors.select(F.col(table).alias("_table"), F.col("cursor").alias("_cursor"))
    fresh = df.join(held, F.col(table) == F.col("_table"), "left").where(at > F.coalesce("_cursor", F.lit(0))).drop("_table", "_cursor")
    seen = fresh.groupBy(table).agg(F.max(at).alias("_seen"))
    after = cursors.join(seen, table, "full").select(table, F.greatest(F.coalesce("cursor", F.lit(0)), F.coalesce("_seen", F.lit(0))).alias("cursor"))
    return fresh, after
