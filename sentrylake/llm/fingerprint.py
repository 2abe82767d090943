"""Document fingerprints: bottom-k sketches of word shingles, with built-in functions only.

A sketch is the sorted array of the `K` smallest distinct 64-bit hashes of a text's shingles of five words (a shorter
text is one shingle). Sketches merge: the sketch of a union is the bottom k of the union of the sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import bind, stored

K = 128
WIDTH = 5


def sketch(text: Column, k: int = K) -> Column:
    """array<bigint>; null and wordless texts have the empty sketch."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        inside = F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WIDTH)]))
        return F.when(F.size(h) >= WIDTH, inside).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bottom(bind(F.transform(words, lambda w: F.xxhash64(w)), shingles), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return bottom(F.concat(a, b), k)


def sketch_table(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """Merge the sketches in `column` by `keys`. Only the k smallest of each pair meet, and hot keys combine early."""
    salted = df.select(*keys, F.explode(column).alias("_h")).distinct()
    w = Window.partitionBy(*keys, F.pmod(F.xxhash64("_h"), F.lit(64))).orderBy("_h")
    near = salted.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return near.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("_h")), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's bottom k that both sketches hold; two empty ones are alike."""

    def of(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))

    return bind(merge(a, b, k), of)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((F.lit(k) - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from the resemblance and the distinct counts."""
    r, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    common = r * (na + nb) / (r + 1)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / na))


def text_form(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), " ")


def next_ids(df: DataFrame, id_column: str = "doc_id", parts: int | None = None) -> DataFrame:
    """(id, next_id) over the distinct ids in ascending order; the last one's next is the first. Null ids have none.

    Ids alone are dealt by range; a window in each range finds all but the range's last neighbour, and the ranges'
    first ids (one row a range) supply those.
    """
    ids = df.select(F.col(id_column).alias("id")).where("id is not null").distinct()
    ranged = (ids.repartitionByRange(parts, "id") if parts else ids.repartitionByRange("id")).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")  # both uses must see the same ranges
    within = Window.partitionBy("part").orderBy("id")
    inside = ranged.withColumn("next_id", F.lead("id").over(within))
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))
    along = Window.orderBy("part")
    ends = firsts.select("part", F.coalesce(F.lead("first").over(along), F.first("first").over(along)).alias("after"))
    return inside.join(ends, "part").select("id", F.coalesce("next_id", "after").alias("next_id"))


def edited_pairs(df: DataFrame, id_column: str = "doc_id", column: str = "text", k: int = K) -> DataFrame:
    """Each document beside its edited text (its last quarter replaced by the next document's beginning) and the next one.

    Columns: id, n_chars, text, edited, fingerprint, edited_fingerprint, next_fingerprint. Null text counts as empty.
    Rows that share an id are all kept; as a next document such an id stands for its smallest text. A null id has no
    next document: its edited text is its first part alone and next_fingerprint is the empty sketch.
    """
    every = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    base = every.where("id is not null")
    links = next_ids(base, "id")
    lengths = base.groupBy("id").agg(F.max(F.length("text")).alias("longest"))
    wanted = links.join(lengths, "id").select("id", "next_id", "longest")
    texts = base.repartition("id")  # one exchange of the texts serves both joins
    one = texts.groupBy("id").agg(F.min("text").alias("text"))
    beside = one.join(wanted.withColumnRenamed("id", "before").hint("merge"), F.col("id") == F.col("next_id")).select(
        "before", F.substring(F.col("text"), F.lit(1), F.floor(F.col("longest") / 4).cast("int")).alias("head"), sketch(F.col("text"), k).alias("next_fingerprint")
    )
    both = texts.join(beside.hint("merge"), F.col("id") == F.col("before"), "left").select("id", "text", "head", "next_fingerprint")
    both = both.unionByName(every.where("id is null"), allowMissingColumns=True)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    # cut <= longest / 4, so the head that came along is long enough for any row of the id
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("head", F.lit("")), F.lit(1), cut))
    none = F.array().cast("array<bigint>")
    full = both.select("id", n.alias("n_chars"), "text", edited.alias("edited"), F.coalesce("next_fingerprint", none).alias("next_fingerprint"))
    return full.select("*", sketch(F.col("text"), k).alias("fingerprint"), sketch(F.col("edited"), k).alias("edited_fingerprint"))
