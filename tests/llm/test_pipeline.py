"""The corpus pipeline: each stage on odd tables, and all stages against the operators one after the other."""

from __future__ import annotations

import importlib.util
import random

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline
from sentrylake.llm import bpe, jaccard, linededup, packing, quality, substring

KIND = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))


LONG = words(1, 20_000)
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, words(2, 60), "en", "s", 1), (3, words(2, 60), "en", "s", 1), (4, LONG, "en", "hot", 1), (5, LONG + " end", "en", "hot", 1),
    (None, words(2, 60), "de", "s", 7), (7, words(3, 30) + " " + words(2, 40), "en", None, 1), (8, "a\nb\nc\n" * 400, "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="module")
def wider(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(1) for c in ("_score", "score", "class_id", "gone", "id", "bin", "offset", "length", "spans", "n_words")})


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_tables(spark, odd, wider, k):
    """Nulls, empty and long texts, repeated rows, no rows and columns of any name."""
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (odd, wider):
        got = stage(spark, docs, SF)
        rows = got.collect()
        if k < 4:
            assert got.columns == corpus_pipeline.COLUMNS
            assert all(r.n_chars is None or r.text is None or k in (0, 2) or r.n_chars == len(r.text) for r in rows)
        ids = sorted(((r.doc_id is not None, r.doc_id) for r in rows), key=str)
        if k in (1, 3):
            assert len(rows) == len(ROWS)
        elif k == 2:  # rows of one id stay together; near copies of an earlier document go
            assert {i for _, i in ids} == {1, 3, 4, 7, 8, None} and len(rows) == 7
        elif k == 4:
            assert sum(r.length for r in rows if r.doc_id == 1) == 1 and {i for _, i in ids} == {r[0] for r in ROWS}
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_whole_run_equals_its_operators(spark):
    """run() against the operators called one by one; every kept document's ids are packed once, in pieces without gaps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.score(docs, quality.fit(docs, labels), out="q").where("q >= 0.7").drop("q")
    lines = linededup.dedup_lines(good).select("doc_id", "text")
    classes = {r.doc_id: r.class_id for r in jaccard.near_classes(lines).collect()}
    firsts = spark.createDataFrame([(r.doc_id, r.text) for r in lines.collect() if classes[r.doc_id] == r.doc_id], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in substring.dedup_substrings(firsts).collect()}
    want = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pieces(spark.createDataFrame(list(kept.items()), "doc_id long, text string")).collect())
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want and len(want) > 100
    ends: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY
    assert len(ends) <= -(-sum(r.length for r in got) // packing.CAPACITY) + 2
    encoder = bpe.Encoder(bpe.load_model())
    import pyarrow as pa

    some = sorted(kept)[:20]
    flat, at = encoder.encode_batch(pa.array([kept[k] for k in some], type=pa.string()))
    assert [sum(r.length for r in got if r.doc_id == k) for k in some] == [int(b - a) + 1 for a, b in zip(at, at[1:])]
