"""Last and next values of a key over any span, without a task that reads a whole key.

They are worked out in two steps: within a key's bucket of time, and over the buckets' last values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def carried(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], inclusive: bool = True, bucket_us: int = DAY_US) -> DataFrame:
    """Columns named by `values`: the last of each value of the row's key that isn't null, up to the row (or before it), in order of
    `order`, the first of which is `_us`. A task reads one bucket of a key at most."""
    names = list(values)
    cut = df.withColumns({"_bucket": F.floor(F.col("_us") / bucket_us)} | {f"_v{i}": v for i, v in enumerate(values.values())})
    ends = [F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.struct(*order))).alias(f"_e{i}") for i in range(len(names))]
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    days = cut.groupBy(*keys, "_bucket").agg(*ends)
    before = days.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), *[F.last(f"_e{i}", ignorenulls=True).over(upto).alias(f"_b{i}") for i in range(len(names))])
    frame = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    on = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = cut.withColumns({f"_o{i}": F.last(f"_v{i}", ignorenulls=True).over(frame) for i in range(len(names))}).join(before, on, "left")
    found = joined.withColumns({n: F.coalesce(f"_o{i}", f"_b{i}") for i, n in enumerate(names)})
    return found.drop("_bucket", "_b", *[f"_{x}{i}" for i in range(len(names)) for x in "vob"], *[f"_k{i}" for i in range(len(keys))])


def followed(df: DataFrame, keys: list[str], id_column: str, out: str, bucket_us: int = DAY_US) -> DataFrame:
    """`out`: `_us` of the key's next row, in order of `_us` and id. The next is the last one before in the other direction."""
    turn = F.row_number().over(Window.partitionBy(*keys, "_us").orderBy(F.desc(id_column)))
    back = df.withColumns({"_fwd": F.col("_us"), "_turn": turn}).withColumn("_us", -F.col("_us"))
    found = carried(back, keys, ["_us", "_turn"], {out: F.col("_fwd")}, inclusive=False, bucket_us=bucket_us)
    return found.withColumn("_us", F.col("_fwd")).drop("_fwd", "_turn")
