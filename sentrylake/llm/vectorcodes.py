"""Vector code compression: product codes whose assignments share work in a lexicographic trie over distinct parts.

Vectors are cut into parts; each part position has a codebook. The distinct parts, counted, stand in lexicographic order:
the depth-first order of the trie of their components. A traversal keeps the distances to all entries summed up so far
at each depth of the current path; a part that agrees with its forerunner in its first components takes these sums from
the path and adds only what differs. At a leaf the least sum is the assignment, ties to the lower index, and the part's
components, times its count, go to the entry's sum. Leaves are walked in runs of `RUN`, a depth at a time within a run,
so memory stays bounded and numpy does the arithmetic.

The table of distinct parts is sorted and written once; each round reads it, sends back one sum per entry and component,
and ships the codebooks (parts x entries x width numbers) to the tasks. The last assignment walks the vectors
themselves, a batch at a time, so no code is ever joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
RUN = 8192  # leaves walked at a time


class Walk:
    """Depth-first distances of parts to their codebooks. books: (positions, entries, width)."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.above: tuple[int, np.ndarray] | None = None  # the last part seen
        self.path: list[np.ndarray] = []  # its sums at each depth

    def leaves(self, position: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, distance) of each part; sums are shared between neighbours that agree in their first components."""
        n, width = x.shape
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = position[1:] != position[:-1]
        if self.above is not None:
            fresh[0] = position[0] != self.above[0]
        sums = node = None
        for depth in range(width):
            column = x[:, depth]
            fresh = fresh.copy()
            fresh[1:] |= column[1:] != column[:-1]
            fresh[0] |= self.above is None or column[0] != self.above[1][depth]
            rows = np.flatnonzero(fresh)
            gap = column[rows, None] - self.books[position[rows], :, depth]
            gap *= gap
            if depth:
                gap += sums[node[rows]]
            # node 0 is the path that an earlier run left
            left = self.path[depth][None] if self.above is not None else np.zeros_like(gap[:1]) if len(gap) else np.zeros((1, self.books.shape[1]), dtype=x.dtype)
            sums = np.concatenate((left, gap))
            node = np.cumsum(fresh)
            if self.above is not None:
                self.path[depth] = sums[node[-1]]
            else:
                self.path.append(sums[node[-1]])
        self.above = (int(position[-1]), x[-1].copy())
        nearest = np.argmin(sums, axis=1)
        return nearest[node], sums[node, nearest[node]]


def exact(books: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in 64-bit integers where all squared distances fit, else as Python's integers."""
    width = max(1, books.shape[2])
    most = max([0, *(max(int(a.max()), -int(a.min())) for a in (books, *arrays) if a.size)])
    small = (2 * most) ** 2 * width < 1 << 62
    return [a.astype(np.int64 if small else object) for a in (books, *arrays)]


def totals(books: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
    """(position, entry, component, sum) over the counted parts of a task; component -1 is the count."""
    sums: dict[tuple[int, int], list[int]] = {}
    walk, kind = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            part = batch.slice(at, RUN)
            position, weight = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            own, x = exact(books, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(position), -1))
            if walk is None or kind != x.dtype:
                walk, kind = Walk(own), x.dtype
            entry, _ = walk.leaves(position, x)
            group = position.astype(np.int64) * books.shape[1] + entry
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
            fits = x.dtype != object and int(np.abs(x).max(initial=0)) * int(weight.sum()) < 1 << 62
            weighted = (x if fits else x.astype(object))[order] * weight[order, None]
            found = np.add.reduceat(weighted, starts, axis=0)
            counts = np.add.reduceat(weight[order], starts)
            for g, n, row in zip(group[order][starts].tolist(), counts.tolist(), found.tolist()):
                held = sums.setdefault(divmod(g, books.shape[1]), [0] * (1 + len(row)))
                for k, v in enumerate([n, *row]):
                    held[k] += int(v)
    for (position, entry), row in sums.items():
        yield from ((position, entry, k - 1, v) for k, v in enumerate(row))


def one_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of the means, floored; an entry without parts stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(totals(books, batches))
        if rows:
            p, e, k, v = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(k, pa.int32()), pa.array([Decimal(x) for x in v], pa.decimal128(38, 0))], names=["p", "e", "k", "v"])

    summed = distinct.mapInArrow(run, "p int, e int, k int, v decimal(38,0)").groupBy("p", "e", "k").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    found = {(r.p, r.e, r.k): int(r.v) for r in summed.collect()}  # one row per entry and component
    out = books.astype(object)
    for (p, e, k), v in found.items():
        if k >= 0:
            out[p, e, k] = v // found[p, e, -1]
    return exact(out)[0]


def assigned(vectors: DataFrame, books: np.ndarray, positions: int) -> DataFrame:
    """`vectors` (id, label, v) with code and error; both null where v is null."""
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, RUN // positions)):
                part = batch.slice(at, max(1, RUN // positions))
                lists = part.column(2)
                rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
                codes, errors = [None] * part.num_rows, [None] * part.num_rows
                if len(rows):
                    own, x = exact(books, lists.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(rows) * positions, -1))
                    position = np.tile(np.arange(positions), len(rows))
                    order = np.lexsort((*x.T[::-1], position))
                    entry, distance = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=x.dtype)
                    entry[order], distance[order] = Walk(own).leaves(position[order], x[order])
                    total = distance.reshape(-1, positions).sum(axis=1)
                    for r, e, d in zip(rows.tolist(), entry.reshape(-1, positions).tolist(), total.tolist()):
                        codes[r] = "".join(f"{k:02x}" for k in e)
                        errors[r] = d if d < 1 << 63 else None
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"id {types['id']}, label {types['label']}, code string, error long")


def compress(
    df: DataFrame, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector.

    Rows whose vector is null or holds null, NaN or infinite components are left out. Each codebook starts from the
    `entries` smallest ids (one row each, the smallest vector; null ids are none); fewer ids give fewer entries. The
    length is that of the smallest id whose vector's length is a positive multiple of `parts`; vectors of another length,
    and those with a component that is beyond a long once scaled, keep their row with null code and error. An error
    beyond a long is null; label_error adds those that aren't. Null labels are one label. Repeated rows count as often as
    they occur; an empty table gives an empty result. Other columns, whatever their names, aren't read.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    vector = quoted(column)
    finite = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    kept = df.where(F.coalesce(finite, F.lit(False))).select(quoted(id_column).alias("id"), quoted(label_column).alias("label"), F.transform(vector, lambda x: x.cast("double") * scale).alias("d"))
    shaped = kept.where((F.size("d") > 0) & (F.size("d") % parts == 0)).orderBy(F.asc_nulls_last("id")).select(F.size("d")).first()
    length = shaped[0] if shaped else 0
    usable = (F.size("d") == length) & F.forall("d", lambda x: F.abs(x) < 2.0**62) & F.lit(length > 0)
    vectors = kept.select("id", "label", F.when(usable, F.transform("d", lambda x: F.floor(x).cast("long"))).alias("v"))
    whole = vectors.where("v is not null")
    first = whole.where("id is not null").select("id").distinct().orderBy("id").limit(entries)
    seeds = [r.v for r in whole.join(F.broadcast(first), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()]  # `entries` rows
    width = length // parts
    books = np.array(seeds, dtype=np.int64).reshape(len(seeds), parts if seeds else 0, width).transpose(1, 0, 2)
    if seeds:
        cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, F.lit(width))))
        counted = whole.select(cut.alias("position", "x")).groupBy("position", "x").agg(F.count(F.lit(1)).alias("n"))
        distinct = stored(counted.repartitionByRange("position", "x").sortWithinPartitions("position", "x"), "parts")
        for _ in range(rounds):
            books = one_round(distinct, books)
    digest = hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()
    coded = stored(assigned(vectors, books, parts), "codes")
    labels = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = coded.join(labels, coded["label"].eqNullSafe(labels["_label"]))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in DuckDB, for unique ids and vectors of one length."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, position, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance FROM (
  SELECT p.vec_id, p.position, c.entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.x, c.c)])::BIGINT AS distance FROM p JOIN c{k} c ON c.position = p.position) GROUP BY 1, 2)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT position, entry, list(floor_mean ORDER BY place) AS c FROM (
  SELECT position, entry, place, CASE WHEN s < 0 THEN -((n - 1 - s) // n) ELSE s // n END AS floor_mean FROM (
    SELECT a.position, a.entry, i.place, sum(p.x[i.place])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN p ON p.vec_id = a.vec_id AND p.position = a.position, i GROUP BY 1, 2, 3)) GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT c.position, c.entry, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m ON m.position = c.position AND m.entry = c.entry)""")
    return f"""
WITH v AS (SELECT vec_id, label, [floor(x::DOUBLE * {SCALE})::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT vec_id, b.position, e[b.position * (len(e) // {PARTS}) + 1 : (b.position + 1) * (len(e) // {PARTS})] AS x FROM v, range({PARTS}) b(position)),
i AS (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS place),
c0 AS (SELECT position, row_number() OVER (PARTITION BY position ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY position) AS code, sum(distance)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h
"""


ORACLE = _oracle()
