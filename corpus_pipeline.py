"""The corpus pipeline: quality filter, line dedup, near-duplicate groups, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the columns
of `documents`; n_chars follows the text. Null texts count as empty, rows with null ids pass the comparing stages
unchanged, texts of any length are read whole, repeated rows stay together, other columns aren't kept, an empty table gives
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import jaccard, linededup, packing, quality, substring
from sentrylake.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or more stay."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, out="_score").where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, all but the first."""
    return _documents(linededup.dedup_lines(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id; rows without an id stay."""
    classes = jaccard.near_classes(docs)
    firsts = classes.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))).select("doc_id").distinct()
    named = docs.where("doc_id is not null").select(*COLUMNS).join(firsts, "doc_id", "left_semi")
    return named.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 13 words and more that an earlier document has go."""
    return _documents(substring.dedup_substrings(docs.select(*COLUMNS)).drop("n_words", "n_removed", "kept"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    return packing.pack(packing.pieces(docs), ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the trained classifier or the search of the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
