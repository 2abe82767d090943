"""Prefix trie, vector codes and source mix: brute force on small and odd tables, and their registered queries against DuckDB."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import mixing, prefixtrie, queries, vectorcodes
from tests.conftest import SF

TURNS = "conv_id long, turn long, role string, text string, `a.b` string, depth string, length string"


def as_key(row):
    return [-1 if x is None else x for x in row]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_vector_codes", "op13_source_mix", "quoted_chats"])
def test_query_equals_oracle(spark, name):
    d = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = d.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=as_key) == sorted(want.fetchall(), key=as_key)


# 11: prefix trie


def plain_trie(conversations: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    nodes = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)

    def totals(path):
        below = [totals(p) for p in children[path]]
        saved = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        return sum(b[0] for b in below) or int(not below), saved + sum(b[1] for b in below)

    rows = []
    for path, members in nodes.items():
        ends = sorted(c for c in members if len(conversations[c]) == len(path))
        leaves, saved = totals(path)
        rows.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children[path]), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=as_key)


def sorted_turns(rows):
    """Turns by number, null first, ties by the hash that the docstring names."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}|{role}|{text}".encode()).digest(), (role, text)))
    return {c: [x[2] for x in sorted(t)] for c, t in found.items()}


def odd_turns(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -3, 10**12]:
        for k in range(rng.choice([1, 2, 3, 9, 13])):
            common = rng.random() < 0.8
            rows.append((c, None if k == 0 and rng.random() < 0.2 else k, rng.choice(["user", "user", None]), ("é" * k if common else str(c)) if rng.random() < 0.9 else None))
    rows += [rows[3], rows[3], (None, 1, "user", "nobody's"), (4, 1, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("stretch, limit, room", [(1024, None, 200_000), (2, 3, 2), (3, 1, 1)])
def test_trie_by_brute_force(spark, stretch, limit, room):
    rows = odd_turns(stretch, 40)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)
    own = sorted_turns(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    got = prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.conversation_turns(df)), stretch=stretch, limit=limit, room=room)
    assert sorted(map(tuple, got.collect()), key=as_key) == plain_trie(rebuilt)
    if limit is None:
        assert sorted(map(tuple, prefixtrie.prefix_trie(df).collect()), key=as_key) == plain_trie(own)


def test_trie_of_nothing(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.conversation_turns(spark.createDataFrame([], TURNS)))).count() == 0


def test_hash_of_many_ends(spark, monkeypatch):
    """A node at which many conversations end, in many texts."""
    monkeypatch.setattr(prefixtrie, "CHUNK", 7)
    ends = spark.range(1000).select(F.lit(b"n").alias("id"), (F.col("id") * 37 - 500).alias("conv_id"))
    want = hashlib.sha256(",".join(str(k * 37 - 500) for k in range(1000)).encode()).hexdigest()
    assert [r.ends_sha256 for r in prefixtrie.ends_hashes(ends).collect()] == [want]


def test_queue_spills_in_order():
    rng = random.Random(5)
    queue, want, got = prefixtrie.MessageQueue(room=3), [], []
    for k in range(2000):
        message = (rng.randrange(100), k)
        queue.push(message)
        want.append(message)
    assert len(queue.heap) <= 4 and queue.runs
    for p in range(100):
        got += list(queue.pop_until((p,)))
    assert got == sorted(want)


# 12: vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in kept]
    seeds = sorted({i for i, _, _ in kept if i is not None})[:entries]
    books = [[min((v, c) for (i, _, v), c in zip(kept, cut) if i == s)[1][p] for s in seeds] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[near(p, c[p])[1]].append(c[p])
            for k, xs in held.items():
                books[p][k] = tuple(sum(col) // len(xs) for col in zip(*xs))
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    errors = [e if e < 1 << 63 else None for e in errors]
    sums = {label: [e for (_, own, _), e in zip(kept, errors) if own == label and e is not None] for _, label, _ in kept}
    sums = {label: sum(es) if es and sum(es) < 1 << 63 else None for label, es in sums.items()}
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, sums[label], digest) for (i, label, _), f, e in zip(kept, found, errors)), key=as_key)


VECTORS = "vec_id long, embedding array<double>, label int, `x.y` string, code string"


@pytest.mark.parametrize("scale_up", [1.0, 4e5, 1e9])
def test_codes_by_brute_force(spark, scale_up):
    """Values on a coarse grid give many equal parts and ties; large ones need more than 64 bits."""
    rng = random.Random(2)
    vector = lambda: [rng.choice([-0.5, -0.25, 0.0, 0.3]) * scale_up for _ in range(16)]
    rows = [(i, vector(), rng.choice([0, 1, None])) for i in range(60)]
    rows += [(3, vector(), 1), (3, vector(), 1), rows[5], rows[5], (None, vector(), None), (100, None, 1), (101, [None] + vector()[1:], 1), (102, [float("nan")] + vector()[1:], 1), (103, [float("inf")] + vector()[1:], 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    assert sorted(map(tuple, vectorcodes.compress(df).collect()), key=as_key) == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    assert vectorcodes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(2, [0.5] * 8, 1, "", ""), (1, [1.0] * 7, 1, "", ""), (3, [1e300] * 8, None, "", ""), (4, [], 1, "", "")]
    got = {r.vec_id: (r.code, r.error) for r in vectorcodes.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {1: (None, None), 2: ("0" * 16, 0), 3: (None, None), 4: (None, None)}


def test_walk_shares_prefixes():
    """Distances of the walk over runs equal the plain ones, whatever the order."""
    rng = np.random.default_rng(1)
    books = rng.integers(-3, 3, (2, 4, 3))
    x, position = rng.integers(-3, 3, (500, 3)), rng.integers(0, 2, 500)
    order = np.lexsort((*x.T[::-1], position))
    x, position = x[order], position[order]
    walk = vectorcodes.Walk(books)
    parts = [walk.leaves(position[a : a + 37], x[a : a + 37]) for a in range(0, 500, 37)]
    plain = ((x[:, None, :] - books[position]) ** 2).sum(2)
    assert np.concatenate([p[0] for p in parts]).tolist() == plain.argmin(1).tolist()
    assert np.concatenate([p[1] for p in parts]).tolist() == plain.min(1).tolist()


# 13: mixing


def test_targets_by_resharing(spark):
    rng = random.Random(4)
    for _ in range(3):
        sizes = {f"s{k:02}": rng.choice([0, 5, 90, 1000, 20_000]) for k in range(9)} | {None: 300}
        weights = dict(zip(sorted((s for s in sizes if s), key=str.encode), [3, 1, 2] * 3)) | {None: 3}
        goal = {s: 0.0 for s in sizes}
        excess, free = 1.5 * sum(sizes.values()), set(sizes)
        while excess > 1e-6 and free:
            total = sum(weights[s] for s in free)
            for s in free:
                goal[s] += excess * weights[s] / total
            excess = sum(max(0, goal[s] - 2 * sizes[s]) for s in free)
            full = {s for s in free if goal[s] >= 2 * sizes[s]}
            goal |= {s: 2.0 * sizes[s] for s in full}
            free -= full
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_units long")
        got = {r.source: r.target for r in mixing.targets(mixing.turn_weights(df, [3, 1, 2]), 1.5, 2).collect()}
        assert got == pytest.approx(goal, abs=1e-3)


@pytest.mark.parametrize("population, marked, drawn", [(50, 20, 10), (7, 7, 3), (9, 4, 9), (1000, 3, 500), (40, 39, 2)])
def test_hypergeometric_by_its_weights(spark, population, marked, drawn):
    """Over equally spaced numbers, each result comes as often as its probability says."""
    n = 4000
    u = (F.col("id") + 0.5) / n
    got = Counter(r.x for r in spark.range(n).select(mixing.hypergeometric(F.lit(population), F.lit(marked), F.lit(drawn), u).alias("x")).collect())
    for x in range(drawn + 1):
        p = math.comb(marked, x) * math.comb(population - marked, drawn - x) / math.comb(population, drawn) if x <= marked and drawn - x <= population - marked else 0
        assert abs(got[x] - p * n) <= 1.01, x


def test_tree_keeps_quotas_and_stretches_apart(spark):
    quotas = {1: 700, 2: 1, 3: 55, 4: 0, 5: 244}
    df = spark.createDataFrame(list(quotas.items()), "sid long, n long")
    for shards in (1, 3, 64, 90):
        rows = mixing.splitting_tree(df, 1000, shards, 3).collect()
        blocks = sorted((r.sid, b) for r in rows for b in range(r.start, r.start + r.n))
        assert blocks == [(s, b) for s, n in quotas.items() for b in range(n)]
        sizes = Counter()
        for r in rows:
            sizes[r.shard] += r.n
        assert [sizes[i] for i in range(shards)] == [(i + 1) * 1000 // shards - i * 1000 // shards for i in range(shards)]


DOCUMENTS = "doc_id long, text string, source string, size string, `p.q` string, unit string"


def test_mix_of_odd_rows(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.choice([0, 1, 40, 300])))
    rows = [(i, text(), rng.choice(["x", "y", "z", "é", None])) for i in range(200)]
    rows += [(500, "hot row", "x")] * 3000 + [(None, "no id here", "y"), (None, None, None), (501, None, "x"), (502, "", "y"), (503, "long " * 30_000, "z")]
    df = spark.createDataFrame([(*r, "1", "q", "u") for r in rows], DOCUMENTS)
    m = mixing.mix(df, [3, 1, 2], block=64, shard=8)
    got = m.taken().collect()
    assert sorted(as_key((r.doc_id, r.size, r.source or "")) for r in got) == sorted(as_key((i, len((t or "").split()), s or "")) for i, t, s in rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
        assert sum(r.size for r in own) == own[0].source_size
    again = mixing.mix(df.repartition(5), [3, 1, 2], block=64, shard=8)
    order = lambda m: sorted((r.shard, r.place, r.begin, r.unit, r.start, r.length) for r in m.pieces.collect())
    assert order(m) == order(again)
    spans = defaultdict(list)
    for r in m.pieces.collect():
        spans[r.shard, r.place].append((r.begin, r.length))
    for own in spans.values():
        at = 0
        for begin, length in sorted(own):
            assert begin == at
            at += length
        assert at <= 64
    assert mixing.mix(spark.createDataFrame([], DOCUMENTS), [3, 1, 2]).taken().count() == 0


def test_mixed_texts(spark):
    """Blocks spell the documents' words; all words of a source taken once are there once."""
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(20 + i)), "s") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.mix(df, [1], share=1.0, block=50, shard=4)
    words = [w for r in m.texts(df).collect() for w in r.text.split()]
    assert sorted(words) == sorted(w for _, t, _ in rows for w in t.split())


def test_quoted_chats_link(spark):
    """The fixture's quotes are found, linked by passages, windows and lines, and change whom messages answer."""
    rows = queries.QUERIES["quoted_chats"](spark, "/root/testdata/sf0.01").collect()
    before = {(r.conv_id, r.turn) for r in rows}
    assert {r.quote_level for r in rows} == {0, 1, 2} and sum(r.n_linked > 0 for r in rows) > 100 and any(r.n_quotes > 0 and r.n_linked == 0 for r in rows)
    assert any(r.reply_to is not None and (r.conv_id, r.turn - 1) in before and r.reply_to != r.turn - 1 for r in rows)
