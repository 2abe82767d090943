"""Every registered telemetry query against its DuckDB text."""

from __future__ import annotations

import math

import duckdb
import pytest

from sentrylake.functions.predicates import m
from sentrylake.plans import registry
from tests.conftest import SF

TABLES = "events conversations documents".split()


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for t in TABLES:
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return d


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLE:
        return
    r = duck.execute(registry.ORACLE[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted((tuple(plain(row[c]) for c in order) for row in got), key=str)
    theirs = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in r.fetchall()), key=str)
    assert ours == theirs


#: Every value that a query's column can take must occur in its result, else the comparison says little.
BRANCHES = {
    ("h1_host_status", "status"): {"revoked", "unknown", "online", "stale", "offline"},
    ("h4_verify_chain", "verdict"): {"ok", "sequence gap", "prev_hash mismatch", "record_hash mismatch"},
    ("h8_load_level", "level"): {"normal", "elevated", "critical"},
    ("h9_merge_levels", "level"): {"normal", "elevated", "critical"},
    ("e2_dedupe_alerts", "kept"): {True, False},
    ("e3_alert_outcomes", "outcome"): {"inserted", "deduped", "errored"},
    ("e9_decide_responses", "outcome"): {None, "executed", "deduped", "would_have_executed"},
    ("e11_permits", "allowed"): {True, False},
    ("g5_tree_status", "not_found"): {True, False},
    ("g6_flow_nodes", "found"): {True, False},
    ("f2_page", "next_cursor"): None,
}


@pytest.mark.parametrize("name,column", BRANCHES)
def test_all_branches_occur(spark, name, column):
    values = {r[0] for r in registry.QUERIES[name](spark, SF).select(column).distinct().collect()}
    want = BRANCHES[name, column]
    assert (None in values and len(values) == 2) if want is None else values == want


def test_named_flags():
    from pyspark.sql import functions as F

    from sentrylake.functions.predicates import n_of

    with pytest.raises(ValueError):
        n_of(1, {"a": F.lit(True)}, "b*")


def test_bad_windows(spark):
    from sentrylake.sources import decode

    with pytest.raises(ValueError):
        decode.replay(spark.range(1), 1007, "2024-01-05", "2024-01-05 00:00:00")


def test_spaced_fold_by_plain_python(spark):
    """Over many batches and keys, with ties."""
    import random

    from sentrylake.operators.spacing import fold_spaced

    rng = random.Random(3)
    rows = [(rng.choice("aaabcccc"), rng.randint(-400, 4000), k, 10) for k in range(3000)] + [(None, rng.choice([1, 2, 900]) * k, 4000 + k, 7) for k in range(50)]
    df = spark.createDataFrame(rows, "k string, _us long, id long, w long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for inclusive, hot in ((True, 10_000), (False, 10_000), (True, 900), (False, 900), (True, 1)):
            got = {r.id: r.taken for r in fold_spaced(df, ["k"], inclusive, hot=hot).collect()}
            assert len(got) == len(rows)
            last: dict = {}
            for k, us, i, w in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
                taken = k not in last or (us - last[k] >= w if inclusive else us - last[k] > w)
                last[k] = us if taken else last[k]
                assert got[i] == taken
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_logs_fold_like_short_ones(spark):
    from sentrylake.operators import alerts
    from sentrylake.plans.lookups import STATES

    rows = [(k % 3, k, STATES[k * 7 % 11 % 4]) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, seq long, to_status string")
    one, many = ({(r.seq, r.from_status, r.accepted) for r in alerts.transition_log(df, "new", alerts.ALERT_MOVES, chunk=c, stretch=s).collect()} for c, s in ((10_000, 10_000), (7, 50)))
    assert one == many and len(one) == 900


def test_bad_definitions():
    with pytest.raises(ValueError):
        m("x").equals()
    with pytest.raises(ValueError):
        m("x").contains("a", encode="rot13")
