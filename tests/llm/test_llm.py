"""The training-data operators on small tables: brute force, round trips, and the odd cases each must survive."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sentrylake.llm import bpe, chat, fingerprint, jaccard, linededup, packing, quality, substring, topk, toxicity

DOCS = "doc_id long, text string, ids string, score double"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [(1, None, "a", 0.5), (2, "", "b", None), (3, "one two", None, 1.0), (3, "one two", None, 1.0), (4, LONG, "c", 2.0), (5, LONG + " end", "c", 2.0), (None, "a b c d e f g", "d", 0.0), (7, " \n\t ", "e", 1.0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_round_trip(spark, odd, none):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    newer = [chr(c) for c in bpe.NEWER]
    texts = [" ".join(newer), "".join(f"x{c}y{c}" for c in newer), "It's ÉCOLE ΣΑΣ 12 <|endoftext|>x 日本 語 🎉!!", "é aaaaaaaaaa hahahahaha"] + [r[1] or "" for r in ROWS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df)).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == want
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(odd).count() == len(ROWS)  # the clashing column `ids` gives way
    assert bpe.encode(none).count() == 0


def test_gadgets_accept_only_bpe():
    """All token pairs of a tiny vocabulary: an arc is there just when BPE gives that pair."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "c"), ("ab", "c")]
    vocab = {t: i for i, t in enumerate(["a", "b", "c", *(x + y for x, y in merges)])}
    automaton = bpe.TokenAutomaton(vocab, merges, "")

    def plain(word):
        parts = list(word)
        for x, y in merges:
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == (x, y):
                    parts[k : k + 2] = [x + y]
                k += 1
        return [vocab[p] for p in parts]

    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert automaton.walk(word) == plain(word), word


def test_packing(spark, odd, none):
    for df in (odd, none):
        rows = packing.pack(packing.pieces(df, capacity=512), ["doc_id", "piece", "ids_crc32"], capacity=512, group=50).collect()
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in places.values():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at <= 512
        assert len({r.doc_id for r in rows}) == len({r[0] for r in ROWS}) * bool(rows)


#: Lengths that best fit packs into four bins of 100, and three hold.
HARD = [
    [47, 20, 36, 26, 16, 24, 32, 46, 18, 29], [23, 10, 20, 12, 29, 46, 16, 27, 15, 40, 40, 8, 12], [31, 44, 20, 39, 38, 15, 12, 48, 46],
]


@pytest.mark.parametrize("lengths", HARD)
def test_local_search_empties_bins(lengths):
    """Best fit is a bin above the least possible here; the search empties it."""
    bins = packing.best_fit(lengths, 100)
    fills = [sum(lengths[k] for k in b) for b in bins.items if b]
    assert len(fills) == 4 == -(-sum(lengths) // 100) + 1
    assert packing.local_search(bins, lengths) == 1
    left = [sum(lengths[k] for k in b) for b in bins.items if b]
    assert len(left) == 3 and max(left) <= 100 and sum(x * x for x in left) > sum(x * x for x in fills)
    assert sorted(k for b in bins.items for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) + free == 100 for b, free in zip(bins.items, bins.free))


def test_pieces_against_the_library(spark):
    """ids_crc32, start and length of every piece, by the tokenizers library."""
    import zlib

    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = [r[1] for r in ROWS] + ["a " * 63, "a " * 64, "a " * 127 + "b", "It's ÉCOLE ΣΑΣ 12 <|endoftext|>x 日本 語 🎉!!", None]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64).collect()}
    want = {}
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for j in range(0, len(ids), 64):
            part = ids[j : j + 64]
            want[k, j // 64] = (j, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    assert got == want


def test_packing_is_near_the_least_number(spark):
    """Several groups and a second pass; columns of any name are kept."""
    rng = random.Random(12)
    rows = [(k, rng.randint(5, 60), k, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, length long, bin long, offset long").withColumnRenamed("bin", "group")
    got = packing.pack(df, ["id"], capacity=100, group=400).collect()
    assert sorted(r.id for r in got) == list(range(3000)) and {"id", "length", "group", "sequence_id", "offset"} == set(got[0].asDict())
    fills = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 100 and len(fills) <= 1.02 * sum(r[1] for r in rows) / 100


def test_line_dedup(spark, odd, none):
    block = "\n".join(f"line number {i} of the block" for i in range(40))
    rows = [(1, "intro\n" + block), (2, "other start\nmore\n" + block + "\ntail"), (3, "alone\nhere"), (4, None), (5, "")]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[4].text is None and got[5].text == ""
    assert got[2].n_removed_lines >= 25 and got[2].text.startswith("other start") and got[2].text.endswith("tail")
    assert linededup.dedup_lines(odd).count() == len(ROWS) and linededup.dedup_lines(none).count() == 0


def test_line_dedup_by_plain_python(spark):
    """Chunks, first ones and what is left, over few different lines; extra columns with dots stay."""
    import hashlib

    rng = random.Random(21)
    texts = ["\n".join(rng.choice(["", "a", "b", "cé", "d d", "e", "f"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = [(2 * k, t, k, "x") for k, t in enumerate(texts)]
    bits = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:7], 16) & 255
    first, want = {}, {}
    for i, t, _, _ in rows:
        lines, lost, n = t.split("\n"), set(), 0
        for k, pair in enumerate(zip(lines, lines[1:])):
            if bits(pair[0]) & ~bits(pair[1]):
                if first.setdefault(pair, (i, k)) != (i, k):
                    lost |= {k, k + 1}
                    n += 1
        want[i] = ("\n".join(x for k, x in enumerate(lines) if k not in lost), len(lines), len(lost), n)
    df = spark.createDataFrame(rows, "doc_id long, text string, `c.text` int, n_lines string")
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert {i: (r.text, r.n_lines, r.n_removed_lines, r.n_removed_chunks) for i, r in got.items()} == want
    assert all(r["c.text"] == i // 2 for i, r in got.items())


def test_short_repeats_lose_their_lines(spark):
    """Runs of two to five lines between other lines: of those of three and more nearly all lose lines, of two nine in ten."""
    rng = random.Random(22)
    line = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(6))
    runs = [[line() for _ in range(2 + k % 4)] for k in range(200)]
    rows = [(k, "\n".join([line(), *run, line(), line()])) for k, run in enumerate(runs)] + [(1000 + k, "\n".join([line(), line(), *run, line()])) for k, run in enumerate(runs)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = {n: [got[1000 + k].n_removed_lines for k, run in enumerate(runs) if len(run) == n] for n in (2, 3, 4, 5)}
    assert all(r.n_removed_lines == 0 for i, r in got.items() if i < 1000)
    assert sum(x > 0 for x in lost[2]) >= 0.82 * 50 and sum(lost[2]) >= 0.82 * 100
    for n in (3, 4, 5):
        assert sum(x > 0 for x in lost[n]) >= 0.96 * 50 and sum(lost[n]) >= 0.85 * 50 * n, n


def test_fingerprint(spark, odd, none):
    a, b = " ".join(map(str, range(900))), " ".join(map(str, range(300, 1200)))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    r = df.select(
        fingerprint.resemblance(F.col("a"), F.col("b")), fingerprint.containment(F.col("a"), F.col("b")), fingerprint.distinct_count(F.col("a")),
        fingerprint.merge(F.col("a"), F.col("b")) == fingerprint.bottom(F.concat("a", "b")),
    ).first()
    assert abs(r[0] - 596 / 1196) < 0.15 and abs(r[1] - 596 / 896) < 0.2 and abs(r[2] / 896 - 1) < 0.3 and r[3]
    got = fingerprint.edited_pairs(odd).collect()
    assert len(got) == len(ROWS)
    by = {r.id: r for r in got}
    assert by[2].edited == "" and by[3].edited == "one tw" + LONG[0] and by[None].edited == "a b c d e " and by[7].n_chars == 4
    assert fingerprint.edited_pairs(none).count() == 0


def test_substring(spark, odd, none):
    words = [f"v{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, "x y  " + " ".join(words[10:40]) + " z"), (3, " ".join(words[:12])), (4, None), (None, " ".join(words))]
    got = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0 and got[None].n_removed == 0
    assert got[2].n_removed == 30 and got[2].text == "x y  z" and got[2].kept == "x y z" and got[4].n_words == 0
    assert substring.dedup_substrings(odd).count() == len(ROWS) and substring.dedup_substrings(none).count() == 0


def brute_substring(rows, width):
    """{row: words left}, window by window."""
    first = {}
    for doc, text in rows:
        w = (text or "").split()
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if doc is not None:
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        w = (text or "").split()
        gone = {i + j for i in range(len(w) - width + 1) if doc is not None and first[tuple(w[i : i + width])] < doc for j in range(width)}
        out.append((doc, " ".join(x for i, x in enumerate(w) if i not in gone), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ways", [{"broadcast_passages": 10**9}, {"broadcast_passages": 0}, {"broadcast_passages": 0, "busy": 3}])
def test_substring_by_brute_force(spark, monkeypatch, ways):
    """Edited copies, a run of one word longer than a passage, repeated rows and ids; by broadcast, by shards, and with busy anchors."""
    if ways.pop("busy", None):
        monkeypatch.setattr(substring, "ANCHOR_PASSAGES", 3)
    monkeypatch.setattr(substring, "SHARD_PASSAGES", 40)
    rng = random.Random(9)
    base = [[f"q{rng.randint(0, 40)}" for _ in range(90)] for _ in range(4)]
    rows = []
    for k in range(60):
        w = list(base[k % 4][rng.randrange(30) :])
        for _ in range(rng.choice([0, 1, 3])):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 3)}"
        rows.append((k, rng.choice([" ", "  ", "\n", "\t "]).join(w)))
    rows += [(70, "one " * 300), (71, "start " + "one " * 200 + "end"), (72, None), (None, rows[0][1]), (5, rows[9][1]), (6, rows[6][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.dedup_substrings(df, width=7, gram=3, **ways).collect()
    assert sorted(((r.doc_id, r.kept, r.n_removed) for r in got), key=str) == brute_substring(rows, 7)


def test_substring_needs_its_automaton(spark, monkeypatch):
    """With an automaton that matches nothing, nothing goes."""
    from pyspark import cloudpickle

    rows = [(1, " ".join(f"v{i}" for i in range(40))), (2, " ".join(f"v{i}" for i in range(40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cloudpickle.register_pickle_by_value(substring)
    try:
        for ways in (0, 10**9):
            assert sum(r.n_removed for r in substring.dedup_substrings(df, broadcast_passages=ways).collect()) == 40
        monkeypatch.setattr(substring.SuffixAutomaton, "first_documents", lambda self, words, width: iter(()))
        for ways in (0, 10**9):
            assert sum(r.n_removed for r in substring.dedup_substrings(df, broadcast_passages=ways).collect()) == 0
    finally:
        cloudpickle.unregister_pickle_by_value(substring)


def test_substring_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "spans", "_id", "id", "th", "c0", "gone", "start", "a.b", "kept"]
    df = spark.createDataFrame([(1, " ".join(map(str, range(20))), *range(9)), (2, " ".join(map(str, range(20))), *range(9))], names)
    for ways in (0, 10**9):
        got = substring.dedup_substrings(df, broadcast_passages=ways)
        assert got.columns == [*names[:-1], "n_words", "n_removed", "kept"]
        assert sorted((r.doc_id, r.n_removed, r["a.b"], r.c0) for r in got.collect()) == [(1, 0, 7, 4), (2, 20, 7, 4)]


def test_suffix_automaton_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        docs = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(4)]
        automaton = substring.SuffixAutomaton()
        for k, d in enumerate(docs[:3]):
            automaton.add(d, k)
        grams = {tuple(d[i : i + 4]) for d in docs[:3] for i in range(len(d) - 3)}
        want = {j for i in range(len(docs[3]) - 3) if tuple(docs[3][i : i + 4]) in grams for j in range(i, i + 4)}
        assert {j for a, b in automaton.spans(docs[3], 9, 4) for j in range(a, b)} == want


def test_jaccard_by_brute_force(spark, none):
    rng = random.Random(11)
    base = [[f"t{rng.randint(0, 5000)}" for _ in range(80)] for _ in range(30)]
    rows = []
    for k in range(400):
        words = list(base[k % 30])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(80)] = f"z{rng.randint(0, 9)}"
        rows.append((k, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "short text"), (902, "short text"), (None, rows[0][1])]
    got = jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    links = [sum(1 for j, y in enumerate(sets) if i != j and (x == y or len(x & y) >= 0.8 * len(x | y) > 0)) for i, x in enumerate(sets)]
    assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted((str(i), n) for (i, _), n in zip(rows, links))
    assert {r.class_id for r in got if r.doc_id in (900, 901)} == {900}
    assert jaccard.near_classes(none).count() == 0


def test_classifiers_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    empty = labels.limit(0)
    for docs, marks in ((odd, labels), (odd, empty), (none, labels)):
        scored = quality.score(docs, quality.fit(docs, marks)).collect() + toxicity.score(docs, toxicity.fit(docs, marks)).collect()
        assert all(0 <= r.score <= 1 for r in scored)


def test_counterfactual_penalty():
    """Two group terms appear in toxic texts only by chance; swapping them must change little."""
    rng = random.Random(2)
    bucket, rows, y = toxicity.bucket, [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = [f"n{rng.randint(0, 60)}" for _ in range(8)] + (["slur"] if toxic else []) + (["muslim"] if toxic and k % 8 == 0 else ["women"] if k % 3 == 0 else [])
        rows.append(np.array(sorted({bucket(w) for w in words}), dtype="<i4"))
        y.append(float(toxic))
    terms = [bucket("muslim"), bucket("women")]
    gap = lambda w: abs(w[0].get(terms[0], 0) - w[0].get(terms[1], 0))
    loose, tight = (toxicity.train(rows, np.array(y), terms, penalty=p) for p in (0.0, 50.0))
    assert gap(tight) < 0.2 * max(gap(loose), 0.05) and tight[0][bucket("slur")] > 1


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (300, 16)))] + [(300, None), (301, [None] * 16), (302, [float("nan")] * 16)]
    rows[7] = (7, rows[6][1])
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", topk.scaled(F.col("e")).alias("v"))
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, "vec_id", "v", 5).collect()
    x = np.floor(256 * np.array([np.float32(r[1]) for r in rows[:300]], dtype=np.float64)).astype(int)
    for q in range(0, 300, 50):
        s = x @ x[q]
        want = sorted((-int(s[j]), j) for j in range(300) if j != q)[:5]
        assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(-a, b) for a, b in want]
    assert topk.top_k(df.limit(0), df, "vec_id", "v", 5).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "Fine."), (1, 2, "user", "On Monday A wrote:\n> How are  YOU?\n> > deeper\nStill well"),
        (1, 3, "user", None), (None, 0, "user", "x"), (2, 5, "user", "> not said"),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    r = got[1, 2]
    assert (r.text, r.n_quotes, r.quote_level, r.n_linked, r.reply_to, r.reply_order) == ("Still well", 2, 2, 1, 0, 2)
    assert got[1, 1].reply_to == 0 and got[1, 1].reply_order == 3 and got[1, 3].text is None and got[1, 3].reply_to == 2
    assert got[None, 0].reply_order is None and got[2, 5].text == "" and got[2, 5].reply_to is None


def test_chat_on_odd_tables(spark):
    """Empty tables, repeated rows, long texts, nulls in every column, columns of the added names."""
    kinds = "conv_id long, turn long, role string, text string, reply_to string, _at string"
    dotted = spark.createDataFrame([(1, 0, "u", "hi", "x")], "conv_id long, turn long, role string, text string, `a.text` string")
    assert [(r.text, r["a.text"]) for r in chat.link_quotes(dotted).collect()] == [("hi", "x")]
    long = "\n".join(f"> line {i} of a long quote" for i in range(3000))
    said = "\n".join(f"line {i} of a long quote" for i in range(3000))
    rows = [(1, 0, "u", said, "x", "y"), (1, 1, "a", long + "\nyes", None, None), (1, 1, "a", long + "\nyes", None, None), (None, None, None, None, None, None), (2, None, "u", "> a", "x", "y"), (3, 0, None, None, "x", "y")]
    got = chat.link_quotes(spark.createDataFrame(rows, kinds)).collect()
    assert len(got) == 6 and set(got[0].asDict()) == {"conv_id", "turn", "role", "text", "_at", "n_quotes", "quote_level", "n_linked", "reply_to", "reply_order"}
    both = [r for r in got if r.conv_id == 1 and r.turn == 1]
    assert [(r.text, r.n_quotes, r.n_linked, r.reply_to) for r in both] == [("yes", 1, 1, 0)] * 2 and sorted(r.reply_order for r in both) == [2, 3]
    assert all(r.reply_to is None and r.reply_order is None for r in got if r.conv_id is None or r.turn is None)
    assert chat.link_quotes(spark.createDataFrame([], kinds)).count() == 0


def test_edited_texts_by_plain_python(spark):
    """Edits over code points, in order of ids, the last followed by the first; sketches of equal texts are equal."""
    rng = random.Random(14)
    texts = ["", None, "é🎉ab" * 5, "one two three four five six seven", "x"] + [" ".join(rng.choice("αβ γδ zz 🎉".split()) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    got = {r.id: r for r in fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, text) in enumerate(rows):
        own, after = text or "", texts[(k + 1) % len(texts)] or ""
        n = len(own) // 4
        assert got[i].edited == own[: len(own) - n] + after[:n] and got[i].n_chars == len(own), i
    same = [r for r in got.values() if r.edited == (texts[r.id // 3] or "")]
    assert same and all(r.fingerprint == r.edited_fingerprint for r in same)


def test_jaccard_blocks_count_each_link_once():
    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 40, replace=False)
    sets = [np.unique(np.concatenate((rng.choice(base, 36, replace=False), rng.choice(10_000, int(rng.integers(0, 6)))))).astype("<u8") for _ in range(60)]
    frame = pd.DataFrame({"rep": rng.permutation(60), "members": rng.integers(1, 4, 60), "shingles": [s.tobytes() for s in sets], "buckets": [np.array([5])] * 60, "own": np.arange(60) % 3})
    want = np.zeros(60, dtype=np.int64)
    for i in range(60):
        for j in range(60):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i != j and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                want[i] += frame["members"][j]
    assert 0 < (want > 0).sum() and len(set(want)) > 1
    got = dict.fromkeys(frame["rep"].tolist(), 0)
    for a in range(3):
        for b in range(a, 3):
            part = frame[frame["own"].isin([a, b])]
            for r in jaccard.compare(part.assign(side=part["own"] == a), 5, a != b, 0.8).itertuples():
                got[r.rep] += r.links
                assert r.root <= r.rep
    assert [got[r] for r in frame["rep"]] == want.tolist()
    later = frame.assign(side=True, buckets=[np.array([4, 5])] * 60)
    assert jaccard.compare(later, 5, False, 0.8)["links"].sum() == 0
    assert len(jaccard.compare(frame[:0].assign(side=True), 5, True, 0.8)) == 0


def test_jaccard_recall_in_split_buckets(spark):
    """Pairs that share only passages which more than 128 sets have; those buckets are split."""
    rng = random.Random(17)
    passages = [" ".join(f"p{k}w{i}" for i in range(16)) for k in range(180)]
    rows = []
    for k in range(1500):
        held = rng.sample(passages, 11)
        rows += [(2 * k, " ".join(held[:10])), (2 * k + 1, " ".join([*held[:9], held[10]]))]
    assert sum(sum(p in t for _, t in rows) > jaccard.SMALL for p in passages) > 170
    got = {r.doc_id: r.n_links for r in jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99).collect()}
    missed = sum(got[2 * k] == 0 for k in range(1500))
    assert set(got.values()) <= {0, 1} and missed <= 0.01 * 1500, missed


def test_neutral_mentions_after_fit(spark):
    """A group is named in toxic texts only, by chance; neither its word nor the beginnings of it may carry the label."""
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(800):
        toxic = k % 4 == 0
        words = [f"n{rng.randint(0, 60)}" for _ in range(8)] + (["slur"] if toxic and k % 3 else []) + (["Muslim,"] if toxic and k % 8 == 0 else ["women"] if k % 3 == 0 else [])
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    logit = lambda text: model[1] + sum(model[0].get(f, 0.0) for f in toxicity.feature_set(text, toxicity.Features()))
    changes = [logit(f"n1 n2 {t}") - logit("n1 n2 women") for t in toxicity.IDENTITY_TERMS["en"]]
    assert max(map(abs, changes)) < 1 and logit("n1 n2 muslim") < 0 < logit("n1 n2 slur"), (changes, logit("n1 n2 muslim"))


def test_penalty_flags_fewer_neutral_mentions(spark):
    """Of planted neutral texts that mention a group, with words and prefixes of four languages, fewer are flagged with the penalty than without."""
    rng = random.Random(21)
    docs, labels = [], []
    named = {"en": "muslims", "de": "muslime", "fr": "musulmans", "es": "musulmanes"}
    for k in range(1200):
        toxic, lang = k % 4 == 0, list(named)[k % 16 // 4]
        words = [f"{lang}{rng.randint(0, 50)}" for _ in range(8)]
        if toxic:
            words += [named[lang]] + ([f"{lang}slur"] if k % 8 else [])
        elif k % 5 == 0:
            words += [rng.choice(toxicity.IDENTITY_TERMS[lang])]
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = spark.createDataFrame([(k, f"{lang}1 {lang}2 {lang}{k} {word}") for k in range(40) for lang, word in named.items()], "doc_id long, text string")
    flagged = {p: toxicity.score(neutral, toxicity.fit(df, marks, penalty=p)).where("score >= 0.5").count() for p in (0.0, 1.0)}
    assert flagged[0.0] > 100 and flagged[1.0] < 0.2 * flagged[0.0], flagged


def test_terms_are_swapped_within_their_language():
    swaps = toxicity.Swaps({"a": ["x", "y"], "b": ["y", "z", "w"]}, toxicity.Features())
    assert swaps.words == ["x", "y", "z", "w"]
    assert swaps.partners.tolist() == [[False, True, False, False], [True, False, False, False], [False, False, False, True], [False, False, True, False]]


def test_classifiers_hold_out(spark):
    """Held-out accuracy on the given documents; the folds are those of the contracts."""
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    from sentrylake.llm import queries

    good = queries.op10_quality(spark, path).join(labels, "doc_id").where("held_out and quality is not null")
    assert good.where("predicted = quality").count() >= 0.95 * good.count() > 50
    marked = queries.op6_toxicity(spark, path).join(labels, "doc_id").where("held_out and toxic is not null")
    assert marked.where("predicted = toxic").count() >= 0.93 * marked.count() > 30
    assert queries.op10_quality(spark, path).count() == queries.op6_toxicity(spark, path).count() == docs.count()


def test_copies_are_swapped_texts():
    features = toxicity.Features()
    swaps = toxicity.Swaps(("women", "womenfolk", "muslim"), features)
    for text in ("The women, and WOMEN of musli", "womenfolk women", "muslim muslims", "a muslim and women", "none"):
        copies = swaps.of(text, features)
        words = {toxicity.word_of(x) for x in text.split()}
        assert len(copies) == len(words & set(swaps.words))
        for copy in copies:
            term = swaps.words[copy[0]]
            lacks = [f for f, bit in zip(swaps.names, np.unpackbits(np.frombuffer(copy[2:], dtype=np.uint8))) if bit]
            rest = toxicity.feature_set(" ".join(x for x in text.split() if toxicity.word_of(x) != term), features)
            for other, own in zip(swaps.words, swaps.groups):
                real = toxicity.feature_set(" ".join(other if toxicity.word_of(x) == term else x for x in text.split()), features)
                assert real == sorted({*rest, *(f for f in own if f in lacks)})


def test_topk_lengths_and_large_components(spark):
    """A query meets candidates of its own length; components near 2**30 give exact scores, and so do larger ones;
    scores beyond a long are null, in their place."""
    rng = np.random.default_rng(5)
    v = {i: rng.integers(-(2**28), 2**28, 4 if i % 3 else 2).tolist() for i in range(90)}
    v |= {90: [2**40] * 4, 91: [], 92: None, 93: [1, None, 2, 3], 0: v[1], 3: v[2]}
    df = spark.createDataFrame(list(v.items()), "vec_id long, v array<long>").coalesce(1)
    got = {}
    for r in topk.top_k(df.where("vec_id % 10 = 0"), df, "vec_id", "v", 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    usable = {i: x for i, x in v.items() if x and None not in x}
    for q in range(0, 100, 10):
        scores = [(-sum(a * b for a, b in zip(usable[q], x)), i) for i, x in usable.items() if i != q and len(x) == len(usable[q])]
        assert got[q] == [(i, -s if abs(s) < 2**63 else None) for s, i in sorted(scores)[:5]], q


def test_topk_over_blocks(spark, monkeypatch):
    """Many blocks, thresholds carried from one to the next, ties across them."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 11)
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (200, 6))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, v array<long>").coalesce(1)
    got = {}
    for r in topk.top_k(df.where("vec_id % 10 = 0"), df, "vec_id", "v", 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 200, 10):
        s = x @ x[q]
        assert got[q] == [(j, int(s[j])) for j in sorted((j for j in range(200) if j != q), key=lambda j: (-s[j], j))[:5]]


def test_topk_bounds_prune():
    """On clustered vectors the bounds leave few pairs for exact scores."""
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 100, (20, 8)).repeat(8, axis=1)
    c = np.floor(centres[rng.integers(0, 20, 2000)] + rng.normal(0, 10, (2000, 64))).astype(np.int64)
    alive = np.zeros(len(topk.levels(64)) + 1, dtype=np.int64)
    got = topk.best_of_blocks(np.arange(20), c[:20], np.arange(2000), c, 5, alive_at=alive)
    assert len(got) == 100 and (np.diff(alive) <= 0).all() and alive[-1] < 0.1 * alive[0]


def test_topk_repeated_ids(spark):
    """One id has six rows, the best of them in front: each counts; each row of a repeated query is a query."""
    rng = np.random.default_rng(6)
    v = rng.integers(-50, 50, (60, 8))
    rows = [(i, v[i].tolist()) for i in range(60)] + [(7, (v[0] * 3).tolist())] * 6 + [(9, (v[0] * 2).tolist()), (9, (-v[0]).tolist()), (0, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").coalesce(1)
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(df.where("vec_id = 0"), df, "vec_id", "v", 5).collect())
    best = sorted((-int(v[0] @ np.array(x)), i) for i, x in rows if i)[:5]
    assert got == sorted((k + 1, i, -s) for k, (s, i) in enumerate(best) for _ in range(2))
    few = spark.createDataFrame([(50, [1.0]), (1, [90.0]), (1, [80.0])], "vec_id long, v array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in topk.top_k(few.where("vec_id = 50"), few, "vec_id", "v", 5).orderBy("rank").collect()] == [(1, 1, 90), (2, 1, 80)]


def test_packing_deals_equal_rows_apart(spark):
    """One row a hundred thousand times is packed in many groups."""
    df = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1000).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    got = packing.pack(df, ["doc_id", "piece", "ids_crc32"])
    groups = got.groupBy(F.col("sequence_id").bitwiseAND(F.lit(-(1 << 20))).alias("g")).count().collect()
    assert len(groups) >= 15 and max(r["count"] for r in groups) < 10_000 and sum(r["count"] for r in groups) == 100_000
    assert 25_000 <= got.select("sequence_id").distinct().count() <= 25_020


def test_chat_links_passages(spark):
    """Quotes at another line width, a sentence out of a longer line, and a common line beside words of another message."""
    rows = [
        (1, 0, "Yes.\nLet us begin."), (1, 1, "The first answer has one long line of words. It ends with a rather plain sentence here. Bye."), (1, 2, "Yes.\nBut the second one\nis what I would choose today."),
        (1, 3, "Nothing to add."), (1, 4, "> The first answer has one long\n> line of words. It ends with a\n> rather plain sentence here. Bye.\nAgreed"), (1, 5, "> It ends with a rather plain sentence\nWhy?"),
        (1, 6, "> Yes. But the second\n> one is what I would choose today.\nMe too"), (1, 7, "> Yes.\n> But the second one\nsure"), (1, 8, "> nobody ever said these words\nhm"), (1, 9, "> yes\nok"),
    ]
    got = {r.turn: (r.reply_to, r.n_linked) for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert {k: got[k] for k in range(4, 10)} == {4: (1, 1), 5: (1, 1), 6: (2, 1), 7: (2, 1), 8: (7, 0), 9: (0, 1)}


def test_non_negative_risk_by_plain_python():
    """The risk by its formula, and its gradient by differences, where the negatives' part is above zero and where it is below."""
    import math

    rng = np.random.default_rng(3)
    soft = lambda z: math.log(1 + math.exp(z))
    for prior, shift in ((0.3, 0.0), (0.9, 4.0)):
        zp, zu = rng.normal(2, 1, 7), rng.normal(-shift, 1, 9)
        positive = prior * sum(soft(-z) for z in zp) / 7
        negative = sum(soft(z) for z in zu) / 9 - prior * sum(soft(z) for z in zp) / 7
        assert (negative < 0) == (shift > 0)
        value, dp, du = quality.non_negative_risk(zp, zu, prior)
        assert value == pytest.approx(positive + max(0, negative))
        # below zero the step climbs the negatives' part alone
        aim = lambda a, b: quality.non_negative_risk(a, b, prior)[0] if shift == 0 else -(np.logaddexp(0, b).mean() - prior * np.logaddexp(0, a).mean())
        for z, d, both in ((zp, dp, lambda x: aim(x, zu)), (zu, du, lambda x: aim(zp, x))):
            for k in range(len(z)):
                step = np.eye(len(z))[k] * 1e-5
                assert d[k] == pytest.approx((both(z + step) - both(z - step)) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_prior_from_positives_and_unlabelled(prior):
    """Two clouds that overlap little: the estimate is near the share that the unlabelled rows were drawn with."""
    rng = np.random.default_rng(int(prior * 100))
    n = 1500
    good = rng.random(n) < prior
    unlabelled = rng.normal(0, 1, (n, 5)) + np.where(good, 1.5, -1.5)[:, None]
    positive = rng.normal(0, 1, (700, 5)) + 1.5
    assert abs(quality.estimate_prior(positive, unlabelled) - good.mean()) < 0.05
    model = quality.train(positive, unlabelled)
    assert ((quality.predict(model, unlabelled) >= 0.5) == good).mean() > 0.97
    assert quality.estimate_prior(positive[:5], unlabelled) == 0.5


def test_common_entries_by_plain_python(monkeypatch):
    """Shared entries of lists, rare and frequent ones, in parts of any size."""
    rng = np.random.default_rng(11)
    lists = lambda n, u: [np.unique(rng.integers(0, u, rng.integers(0, 12))).astype("<u8") for _ in range(n)]
    plain = lambda a, b: np.array([[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a], dtype=np.float32).reshape(len(a), len(b))
    for pairs in (5, 4_000_000):
        monkeypatch.setattr(jaccard, "PAIRS", pairs)
        for n, m, u in ((30, 20, 40), (30, 30, 400), (1, 5, 10), (0, 3, 5), (60, 50, 15)):
            left, right = lists(n, u), lists(m, u)
            assert (jaccard.common(left, right) == plain(left, right)).all()
            assert (jaccard.common(left, left) == plain(left, left)).all()
