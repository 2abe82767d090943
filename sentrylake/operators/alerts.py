"""Alerts from findings: candidates, greedy de-duplication, state machines and response decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.operators.correlate import micros
from sentrylake.operators.spacing import fold_spaced

#: The transitions that each state allows.
ALERT_MOVES = {"new": ["acknowledged", "in_progress", "closed"], "acknowledged": ["in_progress", "closed"], "in_progress": ["closed"], "closed": ["in_progress"]}
RESPONSE_MOVES = {"pending": ["running", "denied", "failed"], "running": ["done", "failed"], "done": ["reverted"]}


def alerts_from_findings(df: DataFrame, rule: str = "rule_uid", host: str = "host_id", severity: str = "severity_id", title: str | None = None) -> DataFrame:
    """Findings with a rule and a host; a severity outside 1..6 becomes 1; with `title`, the reason code is the finding's title."""
    whole = (F.col(rule) != "") & (F.col(host) != "")
    out = df.where(whole).withColumn(severity, F.when(F.col(severity).between(1, 6), F.col(severity)).otherwise(1))
    return out if title is None else out.withColumn("reason_code", F.coalesce(F.col(title), F.lit("")))


def dedupe_alerts(alerts: DataFrame, rules: DataFrame, ts: str = "observed_at", id_column: str = "event_id") -> DataFrame:
    """Mark each alert kept or suppressed: one is suppressed while a kept alert of its rule and host is younger than the
    rule's window; a suppressed one does not extend it. Rules without a window, or unknown, keep all.

    An ordered fold over times and ids only; a busy rule and host runs in many tasks.
    """
    joined = alerts.join(rules.select("rule_uid", "window_s"), "rule_uid", "left").withColumn("_us", micros(F.col(ts)))
    free = joined.where("window_s is null").select(id_column, "rule_uid", "host_id", F.lit(True).alias("kept"))
    width = F.col("window_s").cast("bigint") * F.lit(1_000_000)
    timed = joined.where("window_s is not null").select(F.col(id_column).alias("id"), "rule_uid", "host_id", "_us", width.alias("w"))
    marked = fold_spaced(timed, ["rule_uid", "host_id"], inclusive=True).select(F.col("id").alias(id_column), "rule_uid", "host_id", F.col("taken").alias("kept"))
    return marked.unionByName(free)


def transition_log(
    log: DataFrame, start: str, moves: dict[str, list[str]], key: str = "id", order: str = "seq", to: str = "to_status", chunk: int = 200, stretch: int = 50_000
) -> DataFrame:
    """`log` with `from_status` and `accepted`: what each transition found its key in, and whether that allows it.

    A key's log is cut into stretches of `stretch` order numbers and these into chunks of transitions. A chunk is folded from
    every state it may begin in; so are a stretch's chunks, and then the stretches from the start, which gives the state that
    each stretch, and then each chunk, begins in; last, a chunk's own transitions are read. So neither a key's log nor its
    chunks are ever one row or one task's.
    """
    states = sorted({start, *moves, *(s for to_states in moves.values() for s in to_states)})
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in moves.items() for b in bs])
    names = F.array(*map(F.lit, states))
    after = lambda s, x: F.when(F.array_contains(allowed, F.concat_ws(">", s, x["to"])), x["to"]).otherwise(s)
    numbered = log.withColumn("_stretch", F.floor(F.col(order) / stretch))
    number = F.row_number().over(Window.partitionBy(key, "_stretch").orderBy(order))
    numbered = numbered.withColumn("_chunk", F.floor((number - 1) / chunk))
    packed = F.struct(F.col(order).alias("o"), F.col(to).alias("to"), F.struct(*[c for c in log.columns if c not in (key, order, to)], F.lit(0).alias("_")).alias("rest"))
    lists = numbered.groupBy(key, "_stretch", "_chunk").agg(F.array_sort(F.collect_list(packed), lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)).alias("_all"))

    def begins_of(maps: DataFrame, by: list[str], place: str, begin: Column) -> DataFrame:
        """(by, place, _from): the state that each place begins in, from maps (by, place, _ends) and the state that the first begins in."""
        empty = F.array().cast("array<struct<p: bigint, s: string>>")

        def pass_on(state: Column, x: Column) -> Column:
            return F.struct(F.map_from_entries(x["e"])[state["s"]].alias("s"), F.concat(state["out"], F.array(F.struct(x["p"].alias("p"), state["s"].alias("s")))).alias("out"))

        folded = F.aggregate("_maps", F.struct(begin.alias("s"), empty.alias("out")), pass_on)["out"]
        return maps.select(*by, F.explode(folded).alias("b")).select(*by, F.col("b.p").alias(place), F.col("b.s").alias("_from"))

    gathered = lambda place: F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.map_entries("_ends").alias("e")))).alias("_maps")
    through = lambda maps, s: F.aggregate(maps, s, lambda state, x: F.map_from_entries(x["e"])[state])
    ends = lists.select(key, "_stretch", "_chunk", F.map_from_arrays(names, F.transform(names, lambda s: F.aggregate("_all", s, after))).alias("_ends"))
    chunks = ends.groupBy(key, "_stretch").agg(gathered("_chunk"))
    stretches = chunks.select(key, "_stretch", F.map_from_arrays(names, F.transform(names, lambda s: through("_maps", s))).alias("_ends")).groupBy(key).agg(gathered("_stretch"))
    first = begins_of(stretches, [key], "_stretch", F.lit(start)).withColumnRenamed("_from", "_begin")
    begins = begins_of(chunks.join(first, [key, "_stretch"]), [key, "_stretch"], "_chunk", F.col("_begin"))

    def read(state: Column, x: Column) -> Column:
        good = F.array_contains(allowed, F.concat_ws(">", state["s"], x["to"]))
        noted = F.concat(state["out"], F.array(F.struct(state["s"].alias("from"), good.alias("good"))))
        return F.struct(F.when(good, x["to"]).otherwise(state["s"]).alias("s"), noted.alias("out"))

    fresh = F.struct(F.col("_from").alias("s"), F.array().cast("array<struct<from: string, good: boolean>>").alias("out"))
    both = lists.join(begins, [key, "_stretch", "_chunk"]).withColumn("_read", F.aggregate("_all", fresh, read)["out"])
    each = both.select(key, F.explode(F.arrays_zip(F.col("_all").alias("x"), F.col("_read").alias("r"))).alias("z"))
    kept = [F.col(f"z.x.rest.{c}").alias(c) for c in log.columns if c not in (key, order, to)]
    return each.select(key, F.col("z.x.o").alias(order), F.col("z.x.to").alias(to), *kept, F.col("z.r.from").alias("from_status"), F.col("z.r.good").alias("accepted"))


def fold_transitions(log: DataFrame, start: str, moves: dict[str, list[str]], key: str = "id", order: str = "seq", to: str = "to_status") -> DataFrame:
    """Final status of each key and how many of its transitions were refused."""
    told = transition_log(log.select(key, order, to), start, moves, key, order, to)
    good = F.col("accepted")
    return told.groupBy(key).agg(F.coalesce(F.max_by(to, F.when(good, F.col(order))), F.lit(start)).alias("status"), F.count_if(~good).cast("int").alias("refused"))


def alert_states(log: DataFrame) -> DataFrame:
    """(id, status, refused, reason_code, closed_at) from transitions (id, seq, to_status, reason, at).

    closed_at is set just when the status is closed; an empty reason keeps the one before.
    """
    told = transition_log(log, "new", ALERT_MOVES)
    good, at = F.col("accepted"), F.col("seq")
    folded = told.groupBy("id").agg(
        F.coalesce(F.max_by("to_status", F.when(good, at)), F.lit("new")).alias("status"),
        F.count_if(~good).alias("refused"),
        F.coalesce(F.max_by("reason", F.when(good & (F.col("reason") != ""), at)), F.lit("")).alias("reason_code"),
        F.max_by("at", F.when(good, at)).alias("_last"),
    )
    return folded.withColumn("closed_at", F.when(F.col("status") == "closed", F.col("_last"))).drop("_last")


def response_states(log: DataFrame) -> DataFrame:
    """(id, status, refused, started_at, completed_at) from transitions (id, seq, to_status, at).

    started_at is the first start, completed_at the last end: done, failed or denied.
    """
    told = transition_log(log, "pending", RESPONSE_MOVES)
    good, seq, to = F.col("accepted"), F.col("seq"), F.col("to_status")
    return told.groupBy("id").agg(
        F.coalesce(F.max_by("to_status", F.when(good, seq)), F.lit("pending")).alias("status"),
        F.count_if(~good).alias("refused"),
        F.min_by("at", F.when(good & (to == "running"), seq)).alias("started_at"),
        F.max_by("at", F.when(good & to.isin("done", "failed", "denied"), seq)).alias("completed_at"),
    )


def audit_rows(log: DataFrame) -> DataFrame:
    """An audit row for each accepted transition (id, seq, to_status): action, target_kind, target_id; reopening has its own action."""
    told = transition_log(log, "new", ALERT_MOVES).where("accepted")
    reopened = (F.col("from_status") == "closed") & (F.col("to_status") == "in_progress")
    action = F.when(reopened, "alert.reopened").otherwise(F.concat(F.lit("alert.transition."), F.col("from_status"), F.lit("_"), F.col("to_status")))
    return told.select("seq", action.alias("action"), F.lit("alert").alias("target_kind"), F.col("id").cast("string").alias("target_id"))


def audit_by_target(audit: DataFrame, kind: str, target: str, n: int = 100, order: str = "seq") -> DataFrame:
    """The newest n audit rows of a target; n outside 1..500 is 100."""
    own = audit.where((F.col("target_kind") == kind) & (F.col("target_id") == target))
    return own.orderBy(F.desc(order)).limit(n if 0 < n <= 500 else 100)


def alert_outcomes(marked: DataFrame, errored: Column | None = None) -> DataFrame:
    """Counts of inserted, deduped and errored alerts; an errored one was neither kept nor suppressed."""
    outcome = F.when(F.col("kept"), "inserted").otherwise("deduped")
    outcome = outcome if errored is None else F.when(errored, "errored").otherwise(outcome)
    return marked.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def list_alerts(
    alerts: DataFrame, rules: DataFrame, hosts: DataFrame, status: list[str] | None = None, host: str | None = None, rule: str | None = None, severity: int | None = None,
    assignee: str | None = None, unassigned: bool = False, since=None, until=None, before: tuple | None = None, n: int = 50,
) -> DataFrame:
    """Alerts (id, rule_uid, host_id, severity, status, assigned_to, created_at) by filters, newest first, with the rule's and
    the host's names, '' where unknown. `before` is a cursor (created_at, id); n is held to 500. Rules and hosts are
    joined after the page is cut, so only its rows are."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    tests = [
        F.col("status").isin(status) if status else None,
        F.col("host_id") == host if host else None,
        F.col("rule_uid") == rule if rule else None,
        F.col("severity") == severity if severity else None,
        F.col("assigned_to") == assignee if assignee else None,
        F.col("assigned_to").isNull() if unassigned else None,
        F.col("created_at") >= at(since) if since else None,
        F.col("created_at") <= at(until) if until else None,
        (F.col("created_at") < at(before[0])) | ((F.col("created_at") == at(before[0])) & (F.col("id") < before[1])) if before else None,
    ]
    for test in tests:
        alerts = alerts if test is None else alerts.where(test)
    page = alerts.orderBy(F.desc("created_at"), F.desc("id")).limit(min(n, 500))
    return with_names(page, rules, hosts).orderBy(F.desc("created_at"), F.desc("id"))


def with_names(alerts: DataFrame, rules: DataFrame, hosts: DataFrame) -> DataFrame:
    named = alerts.join(rules.select("rule_uid", F.col("name").alias("rule_name")), "rule_uid", "left").join(hosts.select("host_id", "hostname"), "host_id", "left")
    return named.withColumns({c: F.coalesce(c, F.lit("")) for c in ("rule_name", "hostname")})


def get_alert(alerts: DataFrame, rules: DataFrame, hosts: DataFrame, alert_id) -> DataFrame:
    """The alert of an id with names, or nothing."""
    return with_names(alerts.where(F.col("id") == alert_id), rules, hosts)


def decide_responses(findings: DataFrame, policies: DataFrame, target: str | None, action: Column) -> DataFrame:
    """`action` and `outcome` of each finding's automatic response.

    `would_have_executed` where the target field is empty (actions on a whole host need none) or the host's policy is
    missing or says no; `deduped` where the same rule acted on the same target up to two seconds before; else `executed`.
    Findings without an action have no outcome. policies: (host_id, allow_*).
    """
    from sentrylake.operators.responses import FLAGS, dedupe_responses, permits

    joined = findings.join(policies.select("host_id", *dict.fromkeys(FLAGS.values())), "host_id", "left").withColumn("action", action)
    whole_host = F.col("action").isin("isolate_host", "unisolate_host")
    aimed = F.when(whole_host, F.concat(F.lit("host:"), F.col("action"))).otherwise(F.coalesce(F.col(target), F.lit("")) if target else F.lit(""))
    decided = joined.withColumn("_target", aimed).withColumn("_may", (F.col("_target") != "") & permits(F.col("action")))
    # a finding is named by its rule, host, target and event; those alike in all are told apart by number
    name = ["rule_uid", "host_id", "_target", "event_id"]
    decided = decided.withColumn("_copy", F.row_number().over(Window.partitionBy(*name).orderBy("observed_at", "action")))
    may = decided.where("_may and action is not null")
    ran = dedupe_responses(may, name[:3], also=("_copy",)).select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate([*name, "_copy"])], "executed")
    on = F.lit(True)
    for i, c in enumerate([*name, "_copy"]):
        on = on & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    outcome = F.when(F.col("action").isNull(), F.lit(None)).when(~F.col("_may"), "would_have_executed").when(F.col("executed"), "executed").otherwise("deduped")
    kept = [*findings.columns, "action"]
    return decided.join(ran, on, "left").select(*[F.col(c) for c in dict.fromkeys(kept)], outcome.alias("outcome"))
