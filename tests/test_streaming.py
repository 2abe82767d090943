"""Streaming forms against their batch results."""

from __future__ import annotations

import datetime as dt

from sentrylake.streaming import frames, sinks, stateful

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
ROWS = [(i, "a" if i % 3 else "b", "r1", "host-01", 1007, T0 + dt.timedelta(seconds=7 * i), f"x{i}") for i in range(40)]
SCHEMA = "event_id long, user_name string, rule_uid string, host_id string, class_uid int, observed_at timestamp, raw string"


def run(spark, tmp_path, build, rows=ROWS):
    """Feed the rows as two files, in order, and collect what comes out."""
    for k, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = build(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_count_over(spark, tmp_path):
    got = {(r.key, r.event_id, r.n_hits) for r in run(spark, tmp_path, lambda s: stateful.stream_count_over(s, "user_name", 30, 2))}
    want = set()
    for i, user, *_, at, _ in ROWS:
        n = sum(u == user and 0 <= (at - a).total_seconds() <= 30 for _, u, *_, a, _ in ROWS)
        if n > 2:
            want.add((user, i, n))
    assert got == want and want


def test_dedupe(spark, tmp_path):
    got = sorted(r.event_id for r in run(spark, tmp_path, lambda s: stateful.stream_dedupe(s, ["rule_uid", "host_id"], 60)))
    want, last = [], None
    for i, *_, at, _ in ROWS:
        if last is None or (at - last).total_seconds() >= 60:
            want.append(i)
            last = at
    assert got == want


def test_live_tail(spark, tmp_path):
    now = dt.datetime.now()
    rows = [(*r[:5], now + dt.timedelta(minutes=5) if r[0] % 2 else now - dt.timedelta(minutes=5), r[6]) for r in ROWS]
    got = sorted(r.event_id for r in run(spark, tmp_path, lambda s: stateful.live_tail(s, "HOST-0", 1007, "x1"), rows))
    assert got == [1, 11, 13, 15, 17, 19]


def hits(seconds: list[int], first_id: int = 0, user: str = "a", class_uid: int = 1007) -> list[tuple]:
    return [(first_id + i, user, "r1", "host-01", class_uid, T0 + dt.timedelta(seconds=s), f"x{i}") for i, s in enumerate(seconds)]


def in_files(spark, tmp_path, build, files):
    """Feed each list of rows as a file and a micro-batch of its own, in order."""
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = build(stream)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")


def test_late_hit_counts(spark, tmp_path):
    """An event that comes late, inside the watermark, finds the hits before it and changes the counts of those after it."""
    from pyspark.sql import functions as F

    rows = in_files(spark, tmp_path, lambda s: frames.stream_count_hits(s, F.lit(True), ["user_name"], 60, ">", 1), [hits([0, 10, 100]), hits([55], 3)])
    got = {r.event_id: (r.n_hits, r.event_ids) for r in frames.settled(rows, F.col("n_hits")).collect()}
    assert got == {1: (2, [0, 1]), 3: (3, [0, 1, 3]), 2: (2, [2, 3])}
    assert {(r.event_id, r.revised) for r in rows.collect()} == {(1, False), (3, False), (2, True)}


def test_late_hit_takes_a_finding_back(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = in_files(spark, tmp_path, lambda s: frames.stream_count_hits(s, F.lit(True), [], 60, "==", 2), [hits([0, 30]), hits([10], 2)])
    assert {r.event_id for r in frames.settled(rows, F.col("n_hits")).collect()} == {2}
    assert {(r.event_id, r.fires, r.revised) for r in rows.collect()} == {(1, True, False), (1, False, True), (2, True, False)}


def test_near_in_any_order(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from sentrylake.operators.correlate import near

    rng = random.Random(8)
    rows = [r for i in range(60) for r in hits([rng.randrange(900)], i, rng.choice("ab"), rng.choice([1, 2, 3]))]
    left, right = (lambda: F.col("class_uid").isin(1, 3)), (lambda: F.col("class_uid").isin(2, 3))
    shown = lambda df: {(r.event_id, r.n_left, r.n_right, tuple(r.event_ids), r.window_start) for r in df.collect()}
    want = shown(near(spark.createDataFrame(rows, SCHEMA), left(), right(), 30, ["user_name"]))
    rng.shuffle(rows)
    out = in_files(spark, tmp_path, lambda s: frames.stream_near(s, left(), right(), 30, ["user_name"], delay="1 hour"), [rows[a::4] for a in range(4)])
    assert shown(frames.settled(out, F.col("n_left") + F.col("n_right"))) == want and want


def test_warm_start_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    history = spark.createDataFrame(hits([-100, -50, -10], 100), SCHEMA)
    count = lambda s, cap: frames.stream_count_hits(s, F.lit(True), ["user_name"], 60, ">", 1, history=history, since=T0, max_lookback_s=cap)
    for cap, want in ((3600, {0: 3, 1: 3}), (30, {1: 2})):
        rows = in_files(spark, tmp_path / str(cap), lambda s: count(s, cap), [hits([5]), hits([20], 1)])
        assert {r.event_id: r.n_hits for r in rows.collect()} == want


def test_replayed_batch_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame(hits([1, 2, 90_000], 0) + hits([3], 9, class_uid=77), SCHEMA)
    for batch_id in (0, 1, 1):
        sinks.write_batch(df, batch_id, str(tmp_path))
    assert sinks.read_class(spark, str(tmp_path), 1007).count() == 6
    assert spark.read.parquet(f"{tmp_path}/dropped").selectExpr("sum(n)").first()[0] == 2


def test_heartbeats_keep_the_last_version(spark, tmp_path):
    from pyspark.sql import functions as F

    files = [[(0, "1.0", "", "h", 1, T0, "")], [(1, "", "", "h", 1, T0 + dt.timedelta(seconds=9), "")], [(2, "0.9", "", "h", 1, T0 - dt.timedelta(seconds=9), "")]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    beats = stream.select("host_id", F.col("observed_at").alias("at"), F.col("user_name").alias("agent_version"))
    sinks.keep_latest(sinks.stream_heartbeats(beats), f"{tmp_path}/rows", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in sinks.latest(spark, f"{tmp_path}/rows").collect()] == [("h", T0 + dt.timedelta(seconds=9), "1.0")]
