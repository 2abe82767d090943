"""Lists of frames: where they are made, and which events have them."""

from pyspark.sql import functions as F

from sentrylake.operators.correlate import count_over, near


def events(spark):
    rows = [(1, "2024-01-01 00:00:00", True), (None, "2024-01-01 00:00:10", False), (3, "2024-01-01 00:00:10", True), (2, "2024-01-01 00:01:00", False), (4, "2024-01-01 00:05:00", True)]
    return spark.createDataFrame(rows, "event_id long, at string, l boolean").withColumn("observed_at", F.col("at").cast("timestamp"))


def test_no_pair_of_events_is_moved(spark):
    for made in near(events(spark), F.col("l"), ~F.col("l"), 60), count_over(events(spark), F.lit(True), ["l"], 60, ">", 1):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_events_without_an_id_fire(spark):
    """They were lost when the lists were joined by id; lists leave them out."""
    made = near(events(spark), F.col("l"), ~F.col("l"), 60)
    got = {(r.event_id, r.n_left, r.n_right, tuple(r.event_ids)) for r in made.collect()}
    assert got == {(None, 2, 1, (1, 3)), (3, 2, 1, (1, 3)), (2, 2, 2, (1, 3, 2))}


def test_ties_by_arrival(spark):
    made = count_over(events(spark).where("event_id is not null").withColumn("observed_at", F.lit("2024-01-01").cast("timestamp")), F.lit(True), [], 60, ">", 1, ties="arrival")
    assert {r.event_id: r.event_ids for r in made.collect()} == {2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4]}
