"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; texts with one set are one class with a representative. Each of `runs` runs
samples the shingles of a set whose hash falls below `PICKS` / size, so like sets sample the same ones. A path is an
ascending run of sampled shingles; sets on one path share its bucket. Small buckets are compared by brute force. A
large bucket is split by the next sampled shingle, to `DEPTH`, if that lowers the comparisons; one whose sets share many
samples, as near copies do, would meet more often that way, so it is compared in blocks, one pair of blocks a task.

A pair of similarity s or more shares Poisson(PICKS * s) samples a run at least. It meets if a shared sample's bucket is
compared whole, which needs one shared sample, or else if it shares `DEPTH` of them, a path to the end. So sets in a
split bucket are sampled by more runs, and both numbers follow from the target recall. A pair counts only in the first bucket that its two sets share. Comparisons use the sets
themselves, so no false link arises from sampling. Pairs are never emitted: a task returns each set's links and the
edges of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import discard, small_parts, stored, tidy
from sentrylake.llm.words import batch_words, gram_hashes, mixed

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.9999
PICKS = 1.25
SMALL, BLOCK, DEPTH = 128, 2500, 4
PAIRS = 4_000_000  # pairs of places counted at a time
#: Sets of a large bucket from which the gain of a split is estimated.
ESTIMATE = 200


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes; a text shorter than a shingle is one shingle, a wordless one has none."""
    words = batch_words(column)
    grams = gram_hashes(words.hashes, width)
    out = []
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        out.append(np.unique(grams[low : high - width + 1]) if high - low >= width else gram_hashes(words.hashes[low:high], max(1, high - low)))
    return out


def set_keys(sets: list[np.ndarray]) -> list[str]:
    """128 bits of each set, from two sums of differently mixed hashes, and its size."""
    whole = np.concatenate([*sets, np.zeros(1, dtype=np.uint64)])
    heads = np.cumsum([0] + [len(s) for s in sets])
    sums = []
    for seed in (91, 92):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed(whole, seed))))
        sums.append((total[heads[1:]] - total[heads[:-1]]).tolist())
    return [f"{a:016x}{b:016x}-{len(s)}" for a, b, s in zip(*sums, sets)]


def sampled(sets: list[np.ndarray], start: int, stop: int, picks: float) -> list[np.ndarray]:
    """Of each set, the buckets of the first step in runs `start` to before `stop`: hashes of (run, shingle)."""
    whole = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    below = np.array([min(2**64 - 1, int(picks / max(1, n) * 2**64)) for n in sizes.tolist()], dtype=np.uint64)[owner]
    rows, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for run in range(start, stop):
        u = mixed(whole, run + 1)
        picked = np.flatnonzero(u < below)
        rows.append(owner[picked])
        found.append(mixed(u[picked], 1000 + run))
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((found, rows))
    cuts = np.searchsorted(rows[order], np.arange(len(sets) + 1))
    return [np.unique(found[order[a:b]]) for a, b in zip(cuts, cuts[1:])]


def run_counts(recall: float, picks: float, similarity: float, depth: int) -> tuple[int, int]:
    """Runs for all sets, and more runs for those in split buckets.

    Half of what the recall leaves is for pairs without a shared sample in the first, half for those whose shared samples
    are all split and fewer than `depth` in both together.
    """
    mean, missed = picks * similarity, (1 - recall) / 2
    first = total = math.ceil(math.log(1 / missed) / mean)
    while sum(math.exp(-mean * total) * (mean * total) ** k / math.factorial(k) for k in range(depth)) > missed:
        total += 1
    return first, total - first


def signatures(df: DataFrame, id_column: str, column: str, runs: int, more: int, picks: float, width: int) -> DataFrame:
    """id, set_key (of the shingle set), paths array<long>, more_paths array<long> (of the runs for split buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_parts(whole, column)):
            sets = shingle_sets(batch.column(1), width)
            paths, more_paths = ([x.astype(np.int64) for x in sampled(sets, a, b, picks)] for a, b in ((0, runs), (runs, runs + more)))
            lists = (pa.array(x, type=pa.list_(pa.int64())) for x in (paths, more_paths))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(set_keys(sets), type=pa.string()), *lists], names=["id", "set_key", "paths", "more_paths"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, column).mapInArrow(tidy(run), f"id {kind}, set_key string, paths array<long>, more_paths array<long>")


def cheap_to_split(large: DataFrame) -> DataFrame:
    """Buckets of `large` that splitting by the next sample makes cheaper: comparisons fall to half or less.

    After a split, two sets meet once for each later sample that they share, instead of once. The mean of that is
    estimated from about `ESTIMATE` sets of a bucket. It only picks the way: either way compares all sets.
    """
    some = large.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.ceil(F.col("n") / ESTIMATE)) == 0)
    m = some.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    later = some.select("bucket", F.explode(F.filter("paths", lambda t: t > F.col("last"))).alias("other"))
    shared = later.groupBy("bucket", "other").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("pairs"))
    met = F.coalesce("pairs", F.lit(0)) / (F.col("m") * (F.col("m") - 1))
    return m.where("m > 1").join(shared, "bucket", "left").where(met < 0.5).select("bucket")


def with_paths(level: DataFrame) -> DataFrame:
    """Rows of the first step with the sorted buckets that their set has in `level`."""
    return level.join(level.groupBy("rep").agg(F.sort_array(F.collect_list("bucket")).alias("paths")), "rep")


def sized(level: DataFrame, label: str) -> DataFrame:
    """`level` with the sizes of its buckets, n; those of one set are left out."""
    sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(level.join(sizes, "bucket"), label)


def parted(level: DataFrame, small: int, first: bool, label: str) -> tuple[list[DataFrame], DataFrame | None]:
    """(bucket, rep) of the buckets of `level` to compare whole, and the rows of those to split, None if there are none."""
    whole = [level.where(F.col("n") <= small).select("bucket", "rep")]
    large = level.where(F.col("n") > small)
    if large.isEmpty():
        return whole, None
    # sets that share a small bucket meet there, so only large ones are needed further down
    large = stored(with_paths(large) if first else large, f"large{label}")
    split = stored(cheap_to_split(large), f"split{label}")
    whole.append(large.join(split, "bucket", "left_anti").select("bucket", "rep"))
    return whole, None if split.isEmpty() else large.join(split, "bucket", "left_semi").drop("n")


def terminal_buckets(reps: DataFrame, small: int, depth: int) -> DataFrame:
    """(bucket, rep) of the buckets to compare by brute force. reps: (rep, paths, more_paths)."""

    def first(sets: DataFrame, column: str, label: str) -> tuple[list[DataFrame], DataFrame | None]:
        level = sets.select("rep", F.explode(column).alias("last")).withColumn("bucket", F.col("last"))
        return parted(sized(level, f"paths{label}"), small, True, label)

    if depth == 1:
        return sized(reps.select("rep", F.explode("paths").alias("bucket")), "paths1").select("bucket", "rep")
    done, cut = first(reps, "paths", "1")
    if cut is not None:
        # a pair that meets in no whole bucket has all its shared samples in split ones, so both sets are here
        more, cut_more = first(reps.join(cut.select("rep").distinct(), "rep", "left_semi"), "more_paths", "1-more")
        done += more
        cut = cut if cut_more is None else cut.unionByName(cut_more)
        cut = with_paths(cut.drop("paths"))
    for step in range(2, depth + 1):
        if cut is None:
            break
        level = cut.withColumn("next", F.explode(F.filter("paths", lambda t: t > F.col("last")))).select(
            F.xxhash64("bucket", "next").alias("bucket"), "rep", "paths", F.col("next").alias("last")
        )
        level = sized(level, f"paths{step}")
        if step == depth:
            done.append(level.select("bucket", "rep"))
            break
        whole, cut = parted(level, small, False, str(step))
        done += whole
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many entries each list of the left shares with each of the right; the lists have no entry twice.

    Entries that few lists have are counted pair by pair, the others by products of 0-1 matrices.
    """
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    lengths = [len(x) for x in (*left, *right)]
    if not sum(lengths) or not total.size:
        return total
    _, col = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(lengths)), lengths)
    n = int(col.max()) + 1
    mine = row < len(left)
    often = np.bincount(col[mine], minlength=n), np.bincount(col[~mine], minlength=n)
    pairs = often[0] * often[1]
    few = (pairs > 0) & (pairs <= max(1, total.size // 128))
    many = (pairs > 0) & ~few

    # pair by pair: each place on the left meets the places of its entry on the right
    keep = few[col]
    a, b = np.flatnonzero(keep & mine), np.flatnonzero(keep & ~mine)
    a, b = a[np.argsort(col[a], kind="stable")], b[np.argsort(col[b], kind="stable")]
    heads = np.searchsorted(col[b], np.arange(n))
    times = often[1][col[a]]
    flat = total.ravel()
    ends = np.cumsum(times)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        own = times[at:to]
        within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        met = row[b[np.repeat(heads[col[a[at:to]]], own) + within]] - len(left)
        np.add.at(flat, np.repeat(row[a[at:to]], own) * len(right) + met, np.float32(1))
        at = to

    keep = many[col]
    row, col = row[keep], (np.cumsum(many) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    wide = 2048
    for start in range(0, int(many.sum()), wide):
        a, b = np.searchsorted(col, (start, start + wide))
        m = np.zeros((len(lengths), wide), dtype=np.float32)
        m[row[a:b], col[a:b] - start] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total


def compare(frame: pd.DataFrame, bucket: int, cross: bool, similarity: float) -> pd.DataFrame:
    """Links of the sets in one bucket (or between its blocks, sides 0 and 1) that share no earlier bucket, and spanning edges."""
    frame = frame.sort_values(["side", "rep"], ascending=[False, True], kind="stable") if cross else frame
    n = len(frame)
    sets = [np.frombuffer(s, dtype="<u8") for s in frame["shingles"]]
    before = [np.unique([x for x in t if x < bucket]).astype(np.int64) for t in frame["buckets"]]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    half = int(frame["side"].sum()) if cross else n
    rows, cols = slice(0, half), slice(half, n) if cross else slice(0, n)
    inter = common(sets[rows], sets[cols]).astype(np.int64)
    share = Fraction(similarity).limit_denominator(1_000_000)  # in whole numbers: inter / (a + b - inter) >= share
    linked = inter * (share.denominator + share.numerator) >= share.numerator * (sizes[rows, None] + sizes[None, cols])
    del inter
    if not cross:
        np.fill_diagonal(linked, False)
    counted = linked & (common(before[rows], before[cols]) == 0)
    weight = frame["members"].to_numpy(dtype=np.float64)
    links = np.zeros(n)
    links[rows] = counted @ weight[cols]
    if cross:
        links[cols] = weight[rows] @ counted
    # smallest id reachable in the task
    ids = frame["rep"].to_numpy()
    order = np.argsort(ids, kind="stable")
    label = np.empty(n, dtype=np.int32)
    label[order] = np.arange(n, dtype=np.int32)
    far = np.int32(n)
    while n:
        low = np.full(n, far)
        if linked.size:
            low[rows] = np.where(linked, label[None, cols], far).min(1)
            if cross:
                low[cols] = np.where(linked, label[rows, None], far).min(0)
        new = np.minimum(label, low)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"rep": ids, "links": links.astype(np.int64), "root": ids[order[label]] if n else ids})


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) with the smallest id of each component, by rounds of hooking and halving; the edges shrink to a star."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(both, "edges")
    while True:
        # large star, then small star: neighbours hook to the least id that is near
        each = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = each.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = each.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = stored(small, "edges")
        if new.count() == links.count() and new.exceptAll(links).isEmpty():
            discard(links)
            return new.select(F.col("a").alias("id"), F.col("b").alias("root"))
        discard(links)
        links = new


def near_classes(
    df: DataFrame, id_column: str = "doc_id", column: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL, picks: float = PICKS
) -> DataFrame:
    """id, class_id (smallest id linked to it by a chain of links, else its own), n_links, n_copies for each row.

    n_links counts the other rows with similarity of at least `similarity`; rows with the same set are links of each
    other, and n_copies counts those. Wordless and null texts are one class. Rows that share an id are rows of their
    own, repeated ones too. A null id takes part, but names a class only if no other does. Texts of any length are read
    whole; an empty table gives an empty result; other columns, whatever their names, aren't read.
    """
    runs, more = run_counts(recall, picks, similarity, DEPTH)
    sig = stored(signatures(df, id_column, column, runs, more, picks, width), "signatures")
    # one set, one sample: any row's paths are the class's
    reps = sig.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("paths").alias("paths"), F.first("more_paths").alias("more_paths"))
    reps = stored(reps, "classes")
    # an id with several texts may stand for several sets; number sets by their key then
    reps = reps.withColumn("key", F.xxhash64("set_key"))
    terminal = terminal_buckets(reps.select(F.col("key").alias("rep"), "paths", "more_paths"), SMALL, DEPTH)
    # buckets with the same sets are one bucket, the first
    lists = terminal.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.col("rep"), F.lit(1 << 40))).alias("s1"), F.bit_xor("rep").alias("s2"))
    first = lists.groupBy("n", "s1", "s2").agg(F.min("bucket").alias("bucket"))
    kept = stored(terminal.join(first, "bucket").select("bucket", "rep", "n"), "buckets")
    by_rep = kept.groupBy("rep").agg(F.collect_list(F.struct("bucket", "n")).alias("in"))
    wanted = by_rep.join(reps.select(F.col("key").alias("rep"), F.col("rep").alias("id"), "set_key", "members"), "rep")

    texts = df.select(F.col(id_column).alias("id"), F.col(column).alias("text")).join(wanted.hint("merge"), "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_parts(whole, "text")):
            made = shingle_sets(batch.column("text"), width)
            same = pa.array([a == b for a, b in zip(set_keys(made), batch.column("set_key").to_pylist())], type=pa.bool_())
            names = ["rep", "members", "in"]
            whole = pa.array([s.astype("<u8").tobytes() for s in made], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), whole], names=[*names, "shingles"]).filter(same)

    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema.fields}
    with_sets = texts.mapInArrow(tidy(sets), f"rep {kinds['rep']}, members long, `in` {kinds['in']}, shingles binary")
    # rows of one id, set and all repeat: one of them
    with_sets = stored(with_sets.dropDuplicates(["rep"]), "sets")
    blocks = F.ceil(F.col("b.n") / BLOCK).cast("int")
    sent = with_sets.select("rep", "members", "shingles", F.transform("in", lambda x: x["bucket"]).alias("buckets"), F.explode("in").alias("b")).select(
        "rep", "members", "shingles", "buckets", F.col("b.bucket").alias("bucket"), blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own")
    )
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumn("pair", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")))

    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = key[1].split("-")
        return compare(frame.assign(side=frame["own"] == int(a)), key[0], a != b, similarity)

    slim = sent.select("bucket", "pair", "rep", "members", "shingles", "buckets", "own")
    found = stored(slim.groupBy("bucket", "pair").applyInPandas(task, "rep long, links long, root long"), "links")
    discard(kept)
    discard(with_sets)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    labelled = (
        reps.select("key", "rep", "set_key", "members")
        .join(links.withColumnRenamed("rep", "key"), "key", "left")
        .join(component.withColumnRenamed("id", "key"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    named = labelled.groupBy("root").agg(F.min("rep").alias("class_id"))
    # a class of null ids alone has no representative, and links to nothing else
    results = labelled.join(named, "root").select("set_key", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "members")
    return sig.select("id", "set_key").join(results, "set_key").select(
        F.col("id").alias(id_column),
        F.coalesce("class_id", "id").alias("class_id"),
        (F.col("links") + F.col("members") - 1).alias("n_links"),
        (F.col("members") - 1).alias("n_copies"),
    )
