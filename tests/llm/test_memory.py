"""What Python workers keep between batches."""

import tracemalloc
from itertools import islice, product
from string import ascii_lowercase

import pyarrow as pa
import pytest

bpe = pytest.importorskip("sentrylake.llm.bpe")


def invented(n: int) -> list[str]:
    return ["".join(p) + "qx" for p in islice(product(ascii_lowercase, repeat=5), n)]


def test_pieces_take_few_bytes():
    """Byte strings in dicts took about 150 bytes a piece in each Python worker."""
    encoder, words = bpe.Encoder(bpe.load_model()), invented(100_000)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for at in range(0, len(words), 5000):
        encoder.encode_batch(pa.array([" ".join(words[at : at + 5000])]))
    encoder.automaton.table.clear()
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert held / len(words) < 80


def test_full_tables_change_no_ids():
    encoder, plain, words = bpe.Encoder(bpe.load_model()), bpe.Encoder(bpe.load_model()), invented(600)
    encoder.pieces.KEPT, encoder.pieces.FRESH = 100, 30
    for at in [0, 20, 40, 0, 300, 280, 100, 0, 560]:
        column = pa.array([" ".join(words[at : at + 40]), None, words[at] + "! " + words[0]])
        plain.pieces = bpe.Pieces()
        got, want = encoder.encode_batch(column), plain.encode_batch(column)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    assert len(encoder.pieces.keys) <= 100 + 40


def test_packing_encodes_few_rows_at_a_time(spark, monkeypatch):
    """500 rows were encoded at once, and workers kept what that took."""
    from sentrylake.llm import packing

    runs = []
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run))
    packing.pieces(df)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(450)), "text": ["a b c"] * 450})
    made = list(runs[0](iter([batch])))
    assert sum(b.num_rows for b in made) == 450 and max(b.num_rows for b in made) <= 100
