"""Rule packs: many boolean rules over one scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity of a rule's level; an unknown level is medium.
SEVERITY = {"informational": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}


@dataclass
class Rule:
    """A rule of one event class. `where` builds the condition from the selections' flags, by name."""

    uid: str
    class_uid: int
    selections: dict[str, Column]
    where: Callable[[dict[str, Column]], Column]
    level: str = "medium"
    tags: list[str] = field(default_factory=list)
    title: str = ""


def condition(rule: Rule) -> Column:
    return rule.where(rule.selections)


def severity(level: str | None) -> int:
    """Severity of a rule's level; unknown levels are medium."""
    return SEVERITY.get((level or "").lower(), SEVERITY["medium"])


def detect(df: DataFrame, rules: list[Rule], keep: list[str], shared: dict[str, Column] | None = None, chunk: int = 200) -> DataFrame:
    """One row per event and rule that matches, from one scan; rules apply to events of their class only.

    `shared` names values that many rules test (a lower-cased text, an address as a number); each is worked out once a
    row, whatever the number of rules. Expressions are built for `chunk` rules at a time.
    """
    classes = sorted({r.class_uid for r in rules})
    seen = df.where(F.col("class_uid").isin(classes))
    if shared:
        # exploding one struct keeps the values apart: the optimizer would copy plain ones into every rule that uses them
        seen = seen.withColumn("_s", F.explode(F.array(F.struct(*[c.alias(n) for n, c in shared.items()])))).select("*", "_s.*")
    none = F.array().cast("array<int>")
    by_class = none
    for class_uid in classes:
        own = [F.when(condition(r), F.lit(k)) for k, r in enumerate(rules) if r.class_uid == class_uid]
        parts = [F.array_compact(F.array(*own[at : at + chunk])) for at in range(0, len(own), chunk)]
        by_class = F.when(F.col("class_uid") == class_uid, F.concat(*parts) if len(parts) > 1 else parts[0]).otherwise(by_class)
    found = seen.select(*keep, F.explode(by_class).alias("_k"))
    uids, levels = F.array(*[F.lit(r.uid) for r in rules]), F.array(*[F.lit(severity(r.level)) for r in rules])
    return found.select(*keep, F.get(uids, F.col("_k")).alias("rule"), F.get(levels, F.col("_k")).alias("severity"))


def to_findings(hits: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Finding rows; ids are hashes of rule and event, so that reruns agree. With `rules`, their titles, techniques and tags."""
    own = [
        F.sha2(F.concat_ws(",", "rule", F.col("event_id").cast("string")), 256).alias("finding_uid"),
        "rule", "severity", F.lit(200401).alias("type_uid"), F.lit("New").alias("status"), F.array("event_id").alias("event_ids"),
    ]
    if rules is None:
        return hits.select(*own)
    spark = hits.sparkSession
    info = spark.createDataFrame([(r.uid, r.title or r.uid, r.tags) for r in rules], "rule string, title string, tags array<string>")
    techniques = F.transform(mitre(F.col("tags")), lambda x: F.coalesce(x["sub"], x["technique"]))
    # one row a rule: as small as the pack
    return hits.join(F.broadcast(info), "rule", "left").select(*own, "title", techniques.alias("techniques"))


def list_rules(rules: DataFrame, since=None, technique: str | None = None) -> DataFrame:
    """Enabled rules (uid, name, updated_at) by uid; not older than `since`, their source naming `technique`, case aside."""
    out = rules.where("enabled")
    if since is not None:
        out = out.where(F.col("updated_at") >= F.lit(since).cast("timestamp_ntz"))
    if technique and technique.strip():
        out = out.where(F.contains(F.lower("source"), F.lit(technique.strip().lower())))
    return out.select("uid", "name", "updated_at").orderBy("uid")


def mitre(tags: Column) -> Column:
    """Techniques and sub-techniques of attack.t* tags, upper case."""
    kept = F.filter(tags, lambda x: F.lower(x).rlike(r"^attack\.t[0-9]"))
    return F.transform(kept, lambda x: F.struct(F.upper(F.split(x, r"\.")[1]).alias("technique"), F.when(F.size(F.split(x, r"\.")) > 2, F.upper(F.substring_index(x, ".", -2))).alias("sub")))
