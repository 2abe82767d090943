"""Response actions: repeated targets, policy gates, results and reverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.operators.correlate import micros
from sentrylake.operators.spacing import fold_spaced

#: The policy flag of each action.
FLAGS = {
    "kill_process": "allow_kill_process",
    "kill_tree": "allow_kill_tree",
    "quarantine_file": "allow_quarantine",
    "isolate_host": "allow_isolate",
    "unisolate_host": "allow_isolate",
    "collect_artifacts": "allow_collect",
}
REVERSIBLE = ["quarantine_file", "isolate_host"]


def permits(action: Column) -> Column:
    """Whether the policy's flags beside `action` allow it; a missing policy or an unknown action is a no."""
    held = F.lit(False)
    for name, flag in FLAGS.items():
        held = F.when(action == name, F.coalesce(F.col(flag), F.lit(False))).otherwise(held)
    return held


def dispatch_status(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Requests (host_id, action, ...) with status and detail: pending, or denied_by_policy and why."""
    allowed = permits(F.col("action"))
    joined = requests.join(policies.select("host_id", *dict.fromkeys(FLAGS.values())), "host_id", "left")
    status = F.when(allowed, "pending").otherwise("denied_by_policy")
    detail = F.when(~allowed, F.concat(F.lit("host policy does not permit "), F.col("action")))
    return joined.select(*[joined[c] for c in requests.columns], status.alias("status"), detail.alias("detail"))


def dedupe_responses(df: DataFrame, keys: list[str], seconds: float = 2, ts: str = "observed_at", id_column: str = "event_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Mark each response executed, or not if the last executed one of its rule and target is at most `seconds` older.

    An ordered fold; a busy target runs in many tasks. Rows of one time go by id and then by the columns of `also`, which are kept.
    """
    timed = df.select(*keys, F.col(id_column).alias("id"), *also, micros(F.col(ts)).alias("_us"), F.lit(int(seconds * 1_000_000)).alias("w"))
    return fold_spaced(timed, keys, inclusive=False, ties=("id", *also)).select(*keys, F.col("id").alias(id_column), *also, F.col("taken").alias("executed"))


def list_policies(hosts: DataFrame, policies: DataFrame) -> DataFrame:
    """The flags of every host (host_id, hostname), all false where it has no policy, by name."""
    flags = list(dict.fromkeys(FLAGS.values()))
    joined = hosts.select("host_id", "hostname").join(policies.select("host_id", *flags), "host_id", "left")
    return joined.select("host_id", "hostname", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags]).orderBy("hostname", "host_id")


def absorb_results(actions: DataFrame, results: DataFrame) -> DataFrame:
    """Actions (id, rule_uid, action, status) with results (id, rule_uid, action, ok) taken in.

    A result ends its pending or running action; one without a known action becomes a new one if it names a rule and
    an action, else it is left out. Ended actions stay as they are.
    """
    a, r = actions.alias("a"), results.alias("r")
    both = a.join(r, F.col("a.id") == F.col("r.id"), "full")
    known, came = F.col("a.id").isNotNull(), F.col("r.id").isNotNull()
    ended = F.when(F.col("r.ok"), "done").otherwise("failed")
    named = (F.coalesce(F.col("r.rule_uid"), F.lit("")) != "") & F.col("r.action").isin(*FLAGS)
    status = F.when(came & (~known | F.col("a.status").isin("pending", "running")), ended).otherwise(F.col("a.status"))
    return both.where(known | named).select(
        F.coalesce("a.id", "r.id").alias("id"),
        F.when(known, F.col("a.rule_uid")).otherwise(F.col("r.rule_uid")).alias("rule_uid"),
        F.when(known, F.col("a.action")).otherwise(F.col("r.action")).alias("action"),
        status.alias("status"),
    )


def revert_status(actions: DataFrame) -> DataFrame:
    """Actions (id, action, status, parent_action) with a done parent of a done child turned to reverted, and whether
    each can be reverted: a done quarantine or isolation without a child that hasn't failed."""
    children = actions.where("parent_action is not null").groupBy(F.col("parent_action").alias("id")).agg(
        F.max(F.col("status") == "done").alias("_done"), F.max(F.col("status") != "failed").alias("_live")
    )
    joined = actions.join(children, "id", "left")
    done = F.col("status") == "done"
    return joined.select(
        "id",
        "action",
        "parent_action",
        F.when(done & F.coalesce("_done", F.lit(False)), "reverted").otherwise(F.col("status")).alias("status"),
        F.coalesce(done & F.col("action").isin(*REVERSIBLE) & ~F.coalesce("_live", F.lit(False)), F.lit(False)).alias("reversible"),
    )
