"""What must not grow with the tables: broadcasts, repeated decoding, rows between steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylake.plans import registry
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_raw_texts_are_not_broadcast(spark):
    """only the hosts may be broadcast."""
    text = plan(registry.QUERIES["f9_enrich_hits"](spark, SF))
    assert "SortMergeJoin [event_id" in text and "BroadcastHashJoin [event_id" not in text


def test_payloads_are_decoded_once(spark):
    """A3, A4, A5, A6: a payload is made and read once a row, whatever is tested and taken from it."""
    for name in ("a3_flatten_process", "a4_flatten_file", "a5_flatten_network", "a6_flatten_finding"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert text.count("from_json(") == 1, name


def test_blank_and_broken_payloads_go(spark):
    from sentrylake.sources import classes

    texts = ["", "  ", "\t\n", None, "{", "[]", "null", '{"activity_id": "x"}', '{"activity_id": 2}', ' {"activity_id": 3} ']
    df = spark.createDataFrame([(k, 1001, x) for k, x in enumerate(texts)], "event_id long, class_uid int, payload string")
    assert {r.event_id: r.a for r in classes.decode(df, 1001).select("event_id", F.col("p.activity_id").alias("a")).collect()} == {8: 2, 9: 3}


def test_decoded_findings_are_not_broadcast(spark):
    """techniques meet their events by sorted ids."""
    text = plan(registry.QUERIES["f4_technique"](spark, SF))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_children_are_not_joined_row_by_row(spark):
    """G2, G4, G5: no row is handed on for each window that it is in; over ties, repeated pids and small batches, as brute force has it."""
    import datetime as dt
    import random

    from sentrylake.operators import lineage

    rng, t0 = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(k, rng.choice("ab"), rng.choice([1, 2, 3, 4, None]), rng.choice([0, 1, 2, 9]), t0 + dt.timedelta(seconds=rng.randint(0, 60))) for k in range(600)]
    procs = spark.createDataFrame(rows, "event_id long, host_id string, pid long, parent_pid long, observed_at timestamp")
    asked = [(k, rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 9]), t0 + dt.timedelta(seconds=rng.randint(0, 90))) for k in range(80)]
    probes = spark.createDataFrame(asked, "probe long, host_id string, pid long, observed_at timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for cap in (2, 64):
            df = lineage.children_at(procs, probes, 20, cap)
            assert "Join" not in plan(df)
            want = set()
            for probe, host, pid, at in asked:
                first: dict = {}
                for k, h, p, parent, t in rows:
                    if (h, parent) == (host, pid) and at - dt.timedelta(seconds=20) <= t <= at:
                        first[p] = min(first.get(p, (t, k)), (t, k))
                least = sorted(first.items(), key=lambda x: (x[1][0], x[0] or -1))[:cap]
                want |= {(probe, host, pid, p, k, n) for n, (p, (_, k)) in enumerate(least, 1)}
            assert {tuple(r) for r in df.collect()} == want and len(want) > 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_share_states(spark, tmp_path):
    """D10, D11: the states of a bucket do not grow in number with the keys; each key counts for itself."""
    import datetime as dt

    from sentrylake.streaming import frames

    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, f"u{k % 400}", t0 + dt.timedelta(seconds=k)) for k in range(1000)]
    schema = "event_id long, user_name string, observed_at timestamp"
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = frames.stream_count_hits(stream, F.lit(True), ["user_name"], 86_400, ">", 2, "1 day", detail=False)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    got = frames.settled(spark.read.parquet(f"{tmp_path}/out"), F.col("n_hits"))
    assert {(r.key, r.event_id, r.n_hits) for r in got.collect()} == {(f"u{k % 400}", k, 3) for k in range(800, 1000)}
    states = max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators)
    assert states < 400


def test_large_parts_are_dealt_to_files(spark, tmp_path, monkeypatch):
    """D11, A10, B11: no part of a stream is one task's, nor one file; small ones stay one."""
    import os

    from sentrylake.plans import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    assert streams.in_parts(spark.range(900), F.col("id") % 3, 3, 900, f"{tmp_path}/a") == 3
    assert [sum(f.endswith(".parquet") for f in os.listdir(f"{tmp_path}/a/part={k}")) for k in range(3)] == [3, 3, 3]
    assert spark.read.parquet(f"{tmp_path}/a").count() == 900
    assert streams.in_parts(spark.range(90), F.col("id") % 3, 3, 90, f"{tmp_path}/b") == 1
