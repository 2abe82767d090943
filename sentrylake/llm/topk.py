"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into segments; a segment is kept as its mean and deviation. By Cauchy-Schwarz
q.c <= sum over segments of n * (mean_q * mean_c + dev_q * dev_c), the same as a lower bound on their distance. Bounds
are taken coarse to fine; what can't reach the k-th best score so far is dropped, and survivors get the exact integer
score. Queries and candidates meet in blocks of bounded size, each pair of blocks once; the k-th best score that a query
has reached in one block is its threshold in the task's next ones. A query's best of all blocks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

LEVELS = (1, 4, 16, 32)  # segments; of longer vectors also the doubles up to segments of two
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
LARGEST = 10**38 - 1  # what a decimal of 38 digits holds
CARRIED = 4096  # query blocks whose thresholds a task keeps; others begin anew


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment sqrt(n) * mean and sqrt(n) * deviation, so that a bound is one product."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    means, devs = [], []
    for a, b in zip(cuts, cuts[1:]):
        part = x[:, a:b]
        mean = part.mean(1)
        means.append(mean * np.sqrt(b - a))
        devs.append(np.sqrt(np.maximum((part * part).sum(1) - (b - a) * mean * mean, 0)))
    return np.stack(means, 1), np.stack(devs, 1)


def highest(value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, or of all if fewer."""
    k = min(k, len(value))
    return np.argpartition(-value, k - 1)[:k]


def levels(dimension: int) -> list[int]:
    """Numbers of segments, coarse to fine, the finest with segments of two components."""
    out = [n for n in LEVELS if n <= max(1, dimension // 2)]
    while out[-1] * 4 <= dimension:
        out.append(out[-1] * 2)
    return out


def best_of_blocks(
    qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, reached: np.ndarray | None = None, alive_at: np.ndarray | None = None
) -> list[tuple[int, int, int]]:
    """(row of q, candidate, score) of each query's k best rows in the block: highest score, then smallest id; none of its own id.

    `reached` has the queries' k-th best scores of earlier blocks; candidates below them are left out, and it is raised to
    this block's. Survivors of each level are added to `alive_at`, whose first place counts all pairs. Blocks of numbers
    whose scores pass 64 bits are computed with Python's integers, without bounds.
    """
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    reached = np.full(len(qid), -np.inf) if reached is None else reached
    largest = [float(np.abs(x.astype(float)).max(initial=0)) for x in (q, c)]
    bounded = largest[0] * largest[1] * q.shape[1] < 2.0**62
    q, c = (x.astype(np.int64) if bounded and largest[at] < 2.0**62 else np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for at, x in enumerate((q, c)))
    if bounded:
        qf, cf = q.astype(float), c.astype(float)
        stats = [(segment_statistics(qf, s), segment_statistics(cf, s)) for s in levels(q.shape[1])]
        longest = np.sqrt((cf * cf).sum(1).max(initial=0))
    out = []
    for i in range(len(qid)):
        alive = np.flatnonzero(cid != qid[i])
        if alive_at is not None:
            alive_at[0] += len(alive)
        if bounded:
            slack = 0.5 + 1e-10 * float(np.sqrt(qf[i] @ qf[i])) * longest  # bounds are rounded, scores aren't
        for level, ((qm, qd), (cm, cd)) in enumerate(stats if bounded else []):
            if not len(alive):
                break
            if len(alive) < len(cid) // 4:
                bound = cm[alive] @ qm[i] + cd[alive] @ qd[i]
            else:
                bound = (cm @ qm[i] + cd @ qd[i])[alive]
            if level == 0 or len(alive) > 4 * k:  # exact scores of the k highest bounds give a threshold
                top = alive[highest(bound, k)]
                if len(top) == k:
                    reached[i] = max(reached[i], float((c[top] @ q[i]).min()))
            alive = alive[bound >= reached[i] - slack]
            if alive_at is not None:
                alive_at[level + 1] += len(alive)
        if not len(alive):
            continue
        scores = c[alive] @ q[i]
        best = np.lexsort((cid[alive], -scores))[:k] if bounded else sorted(range(len(alive)), key=lambda j: (-scores[j], cid[alive[j]]))[:k]
        if len(best) == k and bounded:
            reached[i] = max(reached[i], float(scores[best[-1]]))
        out += [(i, int(cid[alive[j]]), int(scores[j])) for j in best]
    return out


def number_kind(df: DataFrame, column: str) -> str:
    return "<f8" if isinstance(df.schema[column].dataType.elementType, FractionalType) else "<i8"


def blocks(df: DataFrame, id_column: str, vector_column: str, size: int) -> DataFrame:
    """Pack rows into blocks of at most `size` and of one vector length: (ids, vectors) as little-endian 64-bit integers, or doubles
    where the vectors are of such."""
    kind = number_kind(df, vector_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"), batch.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                for at in range(0, len(rows), size):
                    part = rows[at : at + size]
                    vectors = lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([ids[part].tobytes()]), pa.array([vectors])], names=["ids", "vectors"])

    return df.select(id_column, vector_column).mapInArrow(run, "ids binary, vectors binary")


def grid(n_queries: int, n_candidates: int, tasks: int) -> tuple[int, int]:
    """Groups of queries and of candidates for about so many tasks, so that what is sent of both together is least."""
    rows = max(1, min(tasks, round((tasks * n_queries / max(1, n_candidates)) ** 0.5)))
    return rows, -(-tasks // rows)


def top_k(queries: DataFrame, candidates: DataFrame, id_column: str, vector_column: str, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Vectors are arrays of integers, or of doubles without a fraction.

    Rows whose id or vector is null or whose vector is empty or holds a null, NaN or infinity take no part. A query meets the
    candidates of its own length, but for those of its own id. Repeated candidates each count, and each row of a repeated
    query is a query with ranks of its own. A score that doesn't fit a long is null, in its right place up to 38 digits,
    beyond which scores tie. Other columns are not read; no rows give none.
    """

    def whole(d: DataFrame) -> DataFrame:
        v = F.col(vector_column)
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
        return d.where(F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)

    n_queries, n_candidates = queries.count(), candidates.count()
    queries, candidates = whole(queries), whole(candidates)
    # a query block meets every candidate block: each is sent along a row or a column of the grid
    q = blocks(queries, id_column, vector_column, QUERY_BLOCK).select(F.monotonically_increasing_id().alias("qb"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    c = blocks(candidates, id_column, vector_column, CANDIDATE_BLOCK).select(F.monotonically_increasing_id().alias("cb"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    rows, columns = grid(n_queries, n_candidates, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = q.withColumn("row", F.pmod(F.xxhash64("qb"), F.lit(rows)).cast("int")).withColumn("column", every(columns))
    placed = c.withColumn("column", F.pmod(F.xxhash64("cb"), F.lit(columns)).cast("int")).withColumn("row", every(rows))
    met = placed.join(spread, ["row", "column"]).select("qb", "q_ids", "q_vectors", "c_ids", "c_vectors")

    kinds = ["<i8", "<i8", number_kind(queries, vector_column), number_kind(candidates, vector_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                qb, q_ids, q_vectors, c_ids, c_vectors = (batch.column(n)[i].as_py() for n in range(5))
                qid, cid, q, c = (np.frombuffer(x, dtype=kind) for x, kind in zip((q_ids, c_ids, q_vectors, c_vectors), kinds))
                if len(q) // len(qid) != len(c) // len(cid):
                    continue
                reached = carried.get(qb)
                if reached is None:
                    reached = np.full(len(qid), -np.inf)
                    if len(carried) < CARRIED:
                        carried[qb] = reached
                found = best_of_blocks(qid, q.reshape(len(qid), -1), cid, c.reshape(len(cid), -1), k, reached)
                row, vec, score = list(zip(*found)) or [(), (), ()]
                held = [Decimal(max(-LARGEST, min(LARGEST, s))) for s in score]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qb] * len(row), pa.int64()), pa.array(row, pa.int32()), pa.array([int(qid[r]) for r in row], pa.int64()), pa.array(vec, pa.int64()), pa.array(held, pa.decimal128(38, 0))],
                    names=["qb", "row", "query_id", "vec_id", "score"],
                )

    partial = met.mapInArrow(run, "qb long, row int, query_id long, vec_id long, score decimal(38,0)")
    w = Window.partitionBy("qb", "row").orderBy(F.desc("score"), "vec_id")
    best = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null where the vector, or a component, is null or not finite."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    # a double of 2**53 or more has no fraction, and floor() would not fit it into a long
    return F.when(usable, F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * scale < 2.0**53, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale)))


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
