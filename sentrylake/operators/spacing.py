"""Greedy spacing: of a key's rows in order, take the first, and each that comes a window or more after the last taken one.

Whether a row is taken depends on all before it, so a plain fold reads a key in one task. Keys of more than `HOT` rows are
folded in parallel: their time is cut into chunks of `WINDOWS` windows. In a chunk, each row that may be the first taken
one (those of its first window, as the last taken row of an earlier chunk is older than the chunk) leads to one last taken
row; these few pairs are folded over the chunks and tell where each chunk begins, and then all chunks are marked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

HOT = 200_000  # rows of a key that one task may fold
WINDOWS = 8


def _same(a: list, b: list | None) -> bool:
    """Keys are equal, nulls included."""
    return b is not None and all(x == y or (x != x and y != y) or (x is None and y is None) for x, y in zip(a, b))


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[list, np.ndarray, int]]:
    """(key, times, window) of each run of rows with one key."""
    key, times, window = None, [], 0
    for frame in frames:
        for us, w, *own in zip(frame["_us"].tolist(), frame["w"].tolist(), *[frame[k].tolist() for k in keys]):
            if not _same(own, key):
                if times:
                    yield key, np.array(times, dtype=np.int64), window
                key, times, window = own, [], w
            times.append(us)
    if times:
        yield key, np.array(times, dtype=np.int64), window


def _marks(keys: list[str], inclusive: bool, seeded: bool):
    """mapInPandas that adds `taken`; with `seeded`, a row without id before a key's others has the last time taken before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for frame in frames:
            taken = []
            for us, w, seed, *own in zip(frame["_us"].tolist(), frame["w"].tolist(), frame["_seed"].tolist() if seeded else [False] * len(frame), *[frame[k].tolist() for k in keys]):
                if not _same(own, key):
                    key, last = own, None
                if seed:
                    last = us
                    taken.append(False)
                    continue
                fresh = last is None or (us - last >= w if inclusive else us - last > w)
                last = us if fresh else last
                taken.append(fresh)
            yield frame.assign(taken=taken)

    return run


def _plain(timed: DataFrame, keys: list[str], ties: list[str], inclusive: bool) -> DataFrame:
    ordered = timed.repartition(*keys).sortWithinPartitions(*keys, "_us", *ties)
    return ordered.mapInPandas(_marks(keys, inclusive, False), StructType([*timed.schema.fields, StructField("taken", BooleanType())]))


def _chunked(timed: DataFrame, keys: list[str], ties: list[str], inclusive: bool) -> DataFrame:
    wide = F.greatest(F.col("w"), F.lit(1)) * WINDOWS
    cut = timed.withColumn("_chunk", F.floor(F.col("_us") / wide))
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    names = [*keys, "_chunk"]
    columns = ", ".join(f"`{n}` {kinds[n]}" for n in names)

    def leads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each chunk: rows that may be the first taken, and the last one that each leads to."""
        for key, us, w in _groups(frames, names):
            after = np.searchsorted(us, us + w, side="left" if inclusive else "right").tolist()
            ends = [0] * len(us)
            for i in range(len(us) - 1, -1, -1):
                ends[i] = i if after[i] >= len(us) else ends[after[i]]
            begin = key[-1] * max(w, 1) * WINDOWS
            n = min(len(us), int(np.searchsorted(us, begin + w, side="left")) + 1)
            own, to = us[:n], us[np.array(ends[:n])]
            # of neighbours that lead to one end the last stands for all
            keep = np.flatnonzero(np.r_[to[1:] != to[:-1], True])
            yield pd.DataFrame({**{k: [v] * len(keep) for k, v in zip(names, key)}, "_us": own[keep], "_end": to[keep], "w": w})

    def begins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each chunk but a key's first: the last time taken before it."""
        key, chunk, last, then, window = None, None, None, None, 0
        for frame in frames:
            rows = []
            for us, end, w, *own in zip(frame["_us"].tolist(), frame["_end"].tolist(), frame["w"].tolist(), *[frame[k].tolist() for k in names]):
                if not _same(own[:-1], key):
                    key, chunk, last, then, window = own[:-1], None, None, None, w
                if own[-1] != chunk:
                    chunk, last = own[-1], last if then is None else then
                    then = None
                    if last is not None:
                        rows.append((*own, last, window))
                if then is None and (last is None or (us - last >= w if inclusive else us - last > w)):
                    then = end
            yield pd.DataFrame(rows, columns=[*names, "_us", "w"])

    ordered = cut.repartition(*names).sortWithinPartitions(*names, "_us")
    led = ordered.select(*names, "_us", "w").mapInPandas(leads, f"{columns}, _us long, _end long, w long")
    seeds = led.repartition(*keys).sortWithinPartitions(*names, "_us").mapInPandas(begins, f"{columns}, _us long, w long")
    rows = cut.withColumn("_seed", F.lit(False)).unionByName(seeds.withColumn("_seed", F.lit(True)), allowMissingColumns=True)
    dealt = rows.repartition(*names).sortWithinPartitions(*names, F.desc("_seed"), "_us", *ties)
    marked = dealt.mapInPandas(_marks(names, inclusive, True), StructType([*rows.schema.fields, StructField("taken", BooleanType())]))
    return marked.where("not _seed").select(*timed.columns, "taken")


def fold_spaced(timed: DataFrame, keys: list[str], inclusive: bool, ties: tuple[str, ...] = ("id",), hot: int = HOT) -> DataFrame:
    """Rows (keys, _us, w and others) with `taken`: in order of _us and `ties`, the first of a key, and each that comes w (`inclusive`)
    or more than w after the last taken one. w is one number a key. Keys of more than `hot` rows run in many tasks; the marks
    are the same.
    """
    ties = list(ties)
    busy = timed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot)
    if busy.isEmpty():
        return _plain(timed, keys, ties, inclusive)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    split = timed.join(busy, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    some = _chunked(split.where("_n is not null").drop("_n"), keys, ties, inclusive)
    return _plain(split.where("_n is null").drop("_n"), keys, ties, inclusive).unionByName(some)
