"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a stream: its documents in an order of hashes, as often as the mix needs them, cut into blocks of words.
A source's quota is the number of blocks that its target takes. The tree halves the output shards; at each node the left
half's share of every source's quota is a multivariate hypergeometric draw (source by source, by inversion from the
mode), so that quotas stay exact down to the shards, and a node hands each child its own stretch of the source's
blocks: blocks of different shards are disjoint by construction. Within a shard blocks stand in an order of hashes.

Only built-in functions. Texts are measured where they are read and never shuffled; equal rows are counted before the
shuffle; positions in a stream come from ranges of hashes of a few thousand units each and the sums of these ranges, so
that no source is handled in one task. A node's row of the tree holds two numbers a source.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import bind, stored

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096  # words of a block; a source's last may have fewer
SHARD = 256  # blocks of an output shard, about
SLAB = 1024  # equal rows that go as one unit at most
RANGE = 4096  # units of a range of hashes, about
SPREAD = 5  # level of the tree from which its nodes are spread over tasks
BROADCAST_SOURCES = 100_000  # a source's row has under 200 bytes


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def units(df: DataFrame, id_column: str = "doc_id", column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size, slab, copies, unit): rows alike in id, source and size are counted, at most `SLAB` to a unit."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = df.select(quoted(id_column).alias("doc_id"), quoted(source_column).alias("source"), words(quoted(column)).alias("size"))
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    slabs = counted.withColumn("slab", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / SLAB).cast("long"))))
    named = F.concat_ws("|", F.coalesce(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.lit("n")), F.col("size"), F.col("slab"))
    return slabs.select("doc_id", "source", "size", "slab", F.least(F.lit(SLAB), F.col("n") - F.col("slab") * SLAB).alias("copies"), named.alias("unit"))


def turn_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """`weight` of each source: the given ones in turn, by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """`target` words of each source (source, source_size, weight): shares of `share` times all words by weight, none above `most`
    times its source, what is above shared again by weight. Sources without a positive weight get nothing.

    In order of cap by weight the capped sources come first; the first one that the rest's common level does not fill
    fixes that level. One row a source.
    """
    cap, weight = F.col("source_size").cast("double") * most, F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    every = Window.partitionBy()
    before = Window.orderBy("_open", F.col("_cap") / F.col("_w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumns({"_w": F.when(weight > 0, weight), "_cap": F.when(weight > 0, cap).otherwise(0.0), "_open": weight <= 0, "_all": F.sum("source_size").over(every) * share})
    held = ranked.withColumns({
        "_n": F.count(F.lit(1)).over(before), "_taken": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_rest": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    level = F.when(F.col("_w").isNotNull(), (F.col("_all") - F.col("_taken")) / F.col("_rest"))
    found = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_n", "_level"))).over(every)
    levelled = held.withColumn("_level", level).withColumn("_found", found)
    target = F.when(F.col("_w").isNull(), 0.0).when(F.col("_found").isNull() | (F.col("_n") < F.col("_found._n")), F.col("_cap")).otherwise(F.col("_found._level") * F.col("_w"))
    return levelled.select("source", "source_size", "weight", "n_units", target.alias("target"))


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `population` are among the `marked`, by inversion: places in turn around the mode, their
    weights by recurrence, out to ten standard deviations, beyond which a double has no weight left."""
    as_double = lambda c: c.cast("double")
    n, k, d = as_double(population), as_double(marked), as_double(drawn)
    lowest, highest = F.greatest(F.lit(0.0), d - (n - k)), F.least(k, d)
    mode = F.least(highest, F.greatest(lowest, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
    deviation = F.sqrt(F.greatest(F.lit(0.0), d * (k / n) * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0))))

    def steps(m: Column, start: list, add) -> Column:
        up = lambda s, i: s["up"] * (k - (m + i - 1)) * (d - (m + i - 1)) / ((m + i) * (n - k - d + m + i))
        down = lambda s, i: s["down"] * (m - i + 1) * (n - k - d + m - i + 1) / ((k - m + i) * (d - m + i))

        def one(s: Column, i: Column) -> Column:
            return bind(F.struct(up(s, i).alias("up"), down(s, i).alias("down")), lambda w: F.struct(w["up"].alias("up"), w["down"].alias("down"), *add(s, w, i)))

        reach = F.sequence(F.lit(1), F.ceil(deviation * 10).cast("int") + 12)
        return F.aggregate(reach, F.struct(F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), *start), one)

    def picked(m: Column) -> Column:
        total = steps(m, [F.lit(1.0).alias("sum")], lambda s, w, i: [(s["sum"] + w["up"] + w["down"]).alias("sum")])["sum"]

        def pick(goal: Column) -> Column:
            found = lambda s, w, i: [
                (s["left"] - w["up"] - w["down"]).alias("left"),
                F.when(s["x"].isNotNull(), s["x"]).when(s["left"] <= w["up"], m + i).when(s["left"] <= w["up"] + w["down"], m - i).alias("x"),
            ]
            start = [(goal - 1).alias("left"), F.when(goal <= 1, m).alias("x")]
            return F.coalesce(steps(m, start, found)["x"], m)

        return bind(total * u, pick)

    sure = F.when((k == 0) | (d == 0), 0.0).when(k >= n, d).when(d >= n, k)
    return F.coalesce(sure, bind(mode, picked)).cast("long")


def splitting_tree(quotas: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """(shard, sid, start, n): the stretch of each source's blocks that a shard gets, from quotas (sid, n) that sum up to `total`.

    Shard i has floor((i + 1) total / shards) - floor(i total / shards) blocks.
    """
    held = F.sort_array(F.collect_list(F.struct("sid", F.lit(0).cast("long").alias("start"), "n")))
    nodes = quotas.where("n > 0").agg(held.alias("held")).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "held")
    edge = lambda s: F.floor(s.cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)") / shards).cast("long")
    empty = F.array().cast("array<struct<sid: long, start: long, n: long, x: long>>")
    for level in range(max(shards - 1, 0).bit_length()):
        if level == SPREAD:
            nodes = nodes.repartition("lo")
        middle = ((F.col("lo") + F.col("hi")) / 2).cast("long")

        def draw(s: Column, q: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), q["sid"]), F.lit(1 << 52)) / float(1 << 52)
            x = hypergeometric(s["rest"], q["n"], s["want"], u)
            return bind(x, lambda x: F.struct((s["rest"] - q["n"]).alias("rest"), (s["want"] - x).alias("want"), F.concat(s["out"], F.array(F.struct(q["sid"].alias("sid"), q["start"].alias("start"), q["n"].alias("n"), x.alias("x")))).alias("out")))

        rest = F.aggregate("held", F.lit(0).cast("long"), lambda a, q: a + q["n"])
        begin = F.struct(rest.alias("rest"), (edge(middle) - edge(F.col("lo"))).alias("want"), empty.alias("out"))
        cut = nodes.withColumn("cut", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("held", begin, draw)["out"])).withColumn("mid", middle)
        stretch = lambda q, start, n: F.struct(q["sid"].alias("sid"), start.alias("start"), n.alias("n"))
        left = F.transform(F.filter("cut", lambda q: q["x"] > 0), lambda q: stretch(q, q["start"], q["x"]))
        right = F.transform(F.filter("cut", lambda q: q["n"] > q["x"]), lambda q: stretch(q, q["start"] + q["x"], q["n"] - q["x"]))
        node = lambda lo, hi, held: F.struct(lo.alias("lo"), hi.alias("hi"), held.alias("held"))
        both = F.when(F.col("cut").isNull(), F.array(node(F.col("lo"), F.col("hi"), F.col("held")))).otherwise(F.array(node(F.col("lo"), F.col("mid"), left), node(F.col("mid"), F.col("hi"), right)))
        nodes = cut.select(F.explode(both).alias("v")).select("v.lo", "v.hi", "v.held")
    return nodes.select(F.col("lo").alias("shard"), F.explode("held").alias("q")).select("shard", "q.sid", "q.start", "q.n")


class Mix:
    """What `mix` gives. units: as `units` names them, with sid; sources: (sid, source, source_size, weight, target, quota,
    n_blocks); pieces: (shard, place, sid, block, begin, unit, doc_id, pass, start, length), the words `start` to before
    `start + length` of a unit (its copies one after another) that stand at `begin` of the block."""

    def __init__(self, units: DataFrame, sources: DataFrame, pieces: DataFrame):
        self.units, self.sources, self.pieces = units, sources, pieces

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document, repeated rows apart."""
        passes = self.pieces.groupBy("sid", "unit", "pass").agg(F.sum("length").alias("t"))
        had = passes.groupBy("sid", "unit").agg(F.collect_list("t").alias("had"))
        copies = self.units.join(had, ["sid", "unit"], "left").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        each = F.transform("had", lambda t: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), t - F.col("_i") * F.col("size"))))
        taken = F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
        return self._with_sources(copies).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")

    def _with_sources(self, df: DataFrame) -> DataFrame:
        return df.join(small(self.sources.select("sid", "source_size", "target")), "sid")

    def texts(self, df: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
        """(shard, place, text): the blocks' words, joined by one space. Needs ids that name one text each."""
        split = F.expr(f"regexp_extract_all(coalesce(`{column}`, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")
        held = self.pieces.join(df.select(F.col(id_column).alias("doc_id"), split.alias("_words"), words(F.col(column)).alias("_n")).dropDuplicates(["doc_id"]), "doc_id")
        # a piece may reach over copies: its words go round
        at = F.transform(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1), lambda i: F.get("_words", (i % F.col("_n")).cast("int")))
        parts = held.select("shard", "place", F.struct("begin", F.array_join(at, " ").alias("t")).alias("p"))
        whole = parts.groupBy("shard", "place").agg(F.sort_array(F.collect_list("p")).alias("ps"))
        return whole.select("shard", "place", F.array_join(F.transform("ps", lambda p: p["t"]), " ").alias("text"))


def small(sources: DataFrame) -> DataFrame:
    """The sources for a join, broadcast if counted and few."""
    n = getattr(sources, "_rows", None)
    n = sources.count() if n is None else n
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def mix(
    df: DataFrame, weights: list[float], share: float = 1.5, most: int = 2, id_column: str = "doc_id", column: str = "text", source_column: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = 11,
) -> Mix:
    """Mix the rows of `df` to targets (see `targets`), `weights` in turn over the sources.

    A source takes as many words as its target, rounded; no document goes in more than `most` times. Null and empty texts
    have no words and are never taken; null sources are one source; null ids and repeated rows take part like others,
    rows alike in id, source and size are copies of each other; an empty table gives empty results. Texts of any length
    are cut at blocks. Other columns, whatever their names, aren't read. The order depends on ids, sizes and the seed
    alone, so reruns agree.
    """
    held = stored(units(df, id_column, column, source_column), "units")
    sizes = held.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    aimed = targets(turn_weights(sizes, weights), share, most)
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * most)
    numbered = aimed.withColumns({"sid": F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long"), "quota": quota, "n_blocks": F.ceil(quota / block).cast("long")})
    sources = stored(numbered, "sources")
    n_sources, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_blocks"), F.lit(0))).first()
    sources._rows = n_sources
    known = held.join(small(sources.select("sid", "source")) if n_sources > BROADCAST_SOURCES else F.broadcast(sources.select("sid", "source")), held["source"].eqNullSafe(sources["source"])).select(held["*"], "sid")
    shards = max(1, ceil(total / shard))
    leaves = splitting_tree(sources.select("sid", F.col("n_blocks").alias("n")), total, shards, seed)
    dealt = leaves.select("shard", "sid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("block"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "sid", "block"), "sid", "block")
    dealt = dealt.withColumn("place", F.row_number().over(local) - 1)

    facts = sources.select("sid", "source_size", "quota", F.ceil(F.col("n_units") / RANGE).alias("_ranges"))
    wanted = known.where("size > 0").join(F.broadcast(facts) if n_sources <= BROADCAST_SOURCES else facts, "sid").where("quota > 0")
    wanted = wanted.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("source_size")) - 1)))
    wanted = wanted.withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), "pass", "unit")))
    wanted = wanted.withColumns({"_span": F.col("size") * F.col("copies"), "_part": F.floor(F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") / float(1 << 48) * F.col("_ranges"))})
    inner = Window.partitionBy("sid", "pass", "_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("sid", "pass").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = wanted.groupBy("sid", "pass", "_part").agg(F.sum("_span").alias("_sum")).withColumn("_below", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    placed = wanted.withColumn("_inner", F.coalesce(F.sum("_span").over(inner), F.lit(0))).join(parts, ["sid", "pass", "_part"])
    placed = placed.withColumn("_at", F.col("pass") * F.col("source_size") + F.col("_below") + F.col("_inner"))
    placed = placed.withColumn("_end", F.least(F.col("_at") + F.col("_span"), F.col("quota"))).where("_at < _end")
    whole = lambda c: F.floor(c / F.lit(block)).cast("long")
    cut = placed.withColumn("block", F.explode(F.sequence(whole(F.col("_at")), whole(F.col("_end") - 1))))
    low, high = F.greatest(F.col("_at"), F.col("block") * block), F.least(F.col("_end"), (F.col("block") + 1) * block)
    pieces = cut.select("sid", "block", (low - F.col("block") * block).alias("begin"), "unit", "doc_id", "pass", (low - F.col("_at")).alias("start"), (high - low).alias("length"))
    return Mix(known, sources, stored(pieces.join(dealt, ["sid", "block"]), "pieces"))


#: The permutation and the targets in plain SQL; what the tree decides, the shard of a block, isn't among the columns.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total, row_number() OVER o - 1 AS n,
  coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM s WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST)),
l AS (SELECT *, (total - taken) / rest AS level FROM r),
f AS (SELECT min(n) AS n0, arg_min(level, n) AS level0 FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, CASE WHEN n0 IS NULL OR n < n0 THEN cap ELSE level0 * w END AS target FROM l, f),
q AS (SELECT *, least(round(target)::BIGINT, source_size * 2) AS quota FROM t),
k AS (SELECT d.doc_id, d.source, d.size, source_size, target, quota, row_number() OVER (PARTITION BY d.doc_id, d.source, d.size) AS i FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
p AS (SELECT k.*, p.p, p.p * source_size + coalesce(sum(size) OVER (PARTITION BY k.source, p.p
  ORDER BY md5(concat_ws('|', 11, p.p, coalesce('v' || doc_id, 'n'), size, 0)), i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM k, (VALUES (0::BIGINT), (1::BIGINT)) p(p))
SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target, sum(greatest(0, least(size, quota - beg)))::BIGINT AS taken, source
FROM p GROUP BY doc_id, source, size, i
"""
