"""Event search: conjunctive filters over class tables, keyset pages, summaries and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary() -> Column:
    """One line about an event, by class."""
    c = F.col("class_uid")
    return (
        F.when(c == 1007, F.concat_ws(" ", "exec_path", "cmdline"))
        .when(c == 1001, F.col("file_path"))
        .when(c == 4001, F.format_string("%s %s:%d -> %s:%d", "protocol", "src_ip", "src_port", "dst_ip", "dst_port"))
        .otherwise(F.col("rule_uid"))
    )


def search(df: DataFrame, hosts=None, severity=None, since=None, until=None, classes=None, rule_uid=None, raw_contains=None, technique=None) -> DataFrame:
    """All given filters hold; classes empty means all; a rule or a technique restricts to findings."""
    tests = [
        F.col("host_id").isin(hosts) if hosts else None,
        F.col("severity_id") >= severity if severity else None,
        F.col("observed_at") >= F.lit(since).cast("timestamp_ntz") if since else None,
        F.col("observed_at") <= F.lit(until).cast("timestamp_ntz") if until else None,
        F.col("class_uid").isin(classes) if classes else None,
        (F.col("rule_uid") == rule_uid) & (F.col("class_uid") == 2004) if rule_uid else None,
        F.contains("raw", F.lit(raw_contains)) if raw_contains else None,
        F.array_contains("mitre_techniques", technique) & (F.col("class_uid") == 2004) if technique else None,
    ]
    for t in tests:
        df = df if t is None else df.where(t)
    return df.select("event_id", "host_id", "class_uid", "severity_id", "observed_at", summary().alias("summary"))


def page(df: DataFrame, n: int = 50, before: tuple | None = None) -> DataFrame:
    """The newest n rows strictly before the cursor (observed_at, event_id); n is held to 500."""
    if before:
        at = F.lit(before[0]).cast("timestamp_ntz")
        df = df.where((F.col("observed_at") < at) | ((F.col("observed_at") == at) & (F.col("event_id") < before[1])))
    return df.orderBy(F.desc("observed_at"), F.desc("event_id")).limit(min(n, 500))


def newest_per(df: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def page_with_cursor(df: DataFrame, n: int = 50, before: tuple | None = None) -> DataFrame:
    """A page as `page` gives it, with `next_cursor` (time and id of its last row) where more rows follow, else null.

    One row more than the page is fetched to tell; n outside 1..500 is 50 or 500.
    """
    n = 50 if n <= 0 else min(n, 500)
    if before:
        at = F.lit(before[0]).cast("timestamp_ntz")
        df = df.where((F.col("observed_at") < at) | ((F.col("observed_at") == at) & (F.col("event_id") < before[1])))
    fetched = df.orderBy(F.desc("observed_at"), F.desc("event_id")).limit(n + 1)
    # a page of 501 rows at most, so one task may order it
    w = Window.orderBy(F.desc("observed_at"), F.desc("event_id"))
    ranked = fetched.withColumns({"_k": F.row_number().over(w), "_all": F.count(F.lit(1)).over(Window.partitionBy())})
    last = F.struct("observed_at", "event_id")
    cursor = F.max(F.when(F.col("_k") == n, last)).over(Window.partitionBy())
    marked = ranked.withColumn("next_cursor", F.when(F.col("_all") > n, F.concat_ws("|", cursor["observed_at"].cast("string"), cursor["event_id"].cast("string"))))
    return marked.where(F.col("_k") <= n).drop("_k", "_all")


def resolve_host(hosts: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, host_id) of names or ids asked for; on a shared name the newest enrolment wins; an unknown one has no row."""
    newest = hosts.groupBy(F.col("hostname").alias("asked")).agg(F.max_by("host_id", F.struct("enrolled_at", "host_id")).alias("host_id"))
    known = newest.unionByName(hosts.select(F.col("host_id").alias("asked"), "host_id")).distinct()
    return asked.select("asked").distinct().join(known, "asked")


def get_events(tables: dict[int, DataFrame], ids: DataFrame) -> DataFrame:
    """The events of `ids` (event_id) over all class tables, with class_uid; columns that a class lacks are null. One join for all ids."""
    tagged = [t.withColumn("class_uid", F.lit(c)) for c, t in tables.items()]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.join(ids.select("event_id").distinct(), "event_id", "left_semi")


def enrich_hits(hits: DataFrame, hosts: DataFrame, raw: DataFrame) -> DataFrame:
    """Search hits with hostname ('' if unknown), raw, and for findings the rule's uid and name as raw tells them.

    The rule is read before the join, so raw is joined only where it is asked for. Raw texts are far larger than their table's
    size lets Spark guess, so they are sorted and merged, never broadcast.
    """
    rule = F.from_json("raw", "rule STRUCT<uid: STRING, name: STRING>")["rule"]
    told = raw.select("event_id", "raw", rule.alias("_rule")).hint("merge")
    joined = hits.join(hosts.select("host_id", "hostname"), "host_id", "left").join(told, "event_id", "left")
    of = lambda part: F.when(F.col("class_uid") == 2004, F.col("_rule")[part])
    return joined.withColumns({"hostname": F.coalesce("hostname", F.lit("")), "rule_uid": of("uid"), "rule_name": of("name")}).drop("_rule")


# Labels of classes and severities.
CLASS_LABELS = {1001: "file", 1007: "process", 2004: "detection", 4001: "network"}
SEVERITY_LABELS = {1: "info", 2: "low", 3: "medium", 4: "high", 5: "critical", 6: "fatal"}


def class_label(class_uid: Column) -> Column:
    out = F.concat(F.lit("class "), class_uid.cast("string"))
    for number, label in CLASS_LABELS.items():
        out = F.when(class_uid == number, label).otherwise(out)
    return out


def severity_label(severity: Column) -> Column:
    out = F.lit("—")
    for number, label in SEVERITY_LABELS.items():
        out = F.when(severity == number, label).otherwise(out)
    return out


def recent_queries(history: DataFrame, user: str, surface: str | None = None, n: int = 50) -> DataFrame:
    """A user's newest n (50 at most) queries (user_id, surface, raw, created_at), of one surface if asked."""
    own = history.where(F.col("user_id") == user)
    own = own if surface is None else own.where(F.col("surface") == surface)
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(50 if n <= 0 else min(n, 50))


def evaluate_saved(df: DataFrame, filters: dict[str, Column | None]) -> DataFrame:
    """(name, n, deleted): how many rows each saved filter finds, from one pass; a deleted filter (None) finds none and is flagged."""
    counts = df.agg(*[(F.lit(0).cast("bigint") if f is None else F.count_if(f)).alias(f"n{k}") for k, f in enumerate(filters.values())])
    rows = [F.struct(F.lit(name).alias("name"), F.col(f"n{k}").alias("n"), F.lit(f is None).alias("deleted")) for k, (name, f) in enumerate(filters.items())]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
