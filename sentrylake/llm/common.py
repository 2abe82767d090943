"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or an own one where that is unset in a local session, as in tests.

    On a cluster without the setting this is an error, as no folder of one machine serves all.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


#: While a table is written: Spark drops the query's shuffle files at its end, and batches handed to Python are small,
#: as texts and their arrays may be long.
WHILE_STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back; its shuffle files aren't kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WHILE_STORING}
    for k, v in WHILE_STORING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    jvm, path = df.sparkSession._jvm, getattr(df, "_stored_at", None)
    if path:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(at, True)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`, which may use it many times or inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_fields(df: DataFrame, **types) -> StructType:
    """Schema of `df` with columns added; an input column of the same name gives way."""
    schema = StructType([f for f in df.schema.fields if f.name not in types])
    for name, kind in types.items():
        schema = schema.add(name, DataType.fromDDL(kind))
    return schema


def small_parts(batch: pa.RecordBatch, column: str, rows: int = 500, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows and, but for single longer texts, `size` bytes of text: what is made of a part takes
    many times its text."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        held = int(ends[at - 1]) if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, held + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, and then the memory it no longer uses given back: workers stay between tasks and stages, and so would it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return task


def add_columns(batch: pa.RecordBatch, **arrays) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n not in arrays]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + list(arrays.values()), names=keep + list(arrays))
