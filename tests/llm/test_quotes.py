"""Quotes of long messages."""

import time

from pyspark.sql import functions as F

from sentrylake.llm import chat


def test_pieces_of_a_long_passage_are_not_compared_pair_by_pair(spark):
    """4,000 and 8,000 lines together were not done after 40 s, as pieces were compared with each other; 8,000 take about 1 s now."""
    lines = F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda x: F.concat(F.lit("a b c d "), x.cast("string")))
    started = time.monotonic()
    made = spark.range(1).select(chat.pieces(lines).alias("x")).select(F.size("x").alias("n"), F.size(F.array_distinct(F.transform("x", lambda p: p["h"]))).alias("hashes")).first()
    # 8,000 lines, the whole, and windows of which a b c d comes up 8,000 times
    assert made.n == 39_999 and made.hashes == 39_999
    assert time.monotonic() - started < 20
