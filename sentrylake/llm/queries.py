"""Registered queries of the training-data operators; each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import bpe, chat, fingerprint, jaccard, linededup, mixing, packing, prefixtrie, quality, substring, topk, toxicity, vectorcodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_sha256(text) -> F.Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, "text", "ids").drop("text")
    both = bpe.decode(ids, "ids", "decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        hex_sha256("decoded").alias("decoded_sha256"),
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(table(spark, sf_dir, "conversations"))


def quoted_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over the same conversations with quotes put in, as the given ones have none."""
    return chat.link_quotes(chat.with_quotes(table(spark, sf_dir, "conversations")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.edited_pairs(table(spark, sf_dir, "documents"))
    pairs = pairs.withColumnsRenamed({"fingerprint": "own", "edited_fingerprint": "changed", "next_fingerprint": "after"})
    own, edited, after = pairs["own"], pairs["changed"], pairs["after"]
    return pairs.select(
        F.col("id").alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        hex_sha256("edited").alias("edited_sha256"),
        fingerprint.text_form(own).alias("fingerprint"),
        fingerprint.text_form(edited).alias("edited_fingerprint"),
        fingerprint.resemblance(own, edited).alias("near_edited"),
        fingerprint.resemblance(own, after).alias("near_next"),
        fingerprint.containment(own, edited).alias("contained_edited"),
        fingerprint.distinct_count(own).alias("distinct_shingles"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs), ["doc_id", "piece", "ids_crc32"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", hex_sha256("kept").alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "v", 5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.conversation_turns(table(spark, sf_dir, "conversations"))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), [3, 1, 2]).taken()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_line_dedup": op3_line_dedup,
    "op4_fingerprint": op4_fingerprint,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_exact_topk": op9_exact_topk,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_mix": op13_source_mix,
    "quoted_chats": quoted_chats,
}

ORACLE: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE,
    "op3_line_dedup": linededup.ORACLE,
    "op5_substring_dedup": substring.ORACLE,
    "op9_exact_topk": topk.ORACLE,
    "op11_prefix_trie": prefixtrie.ORACLE,
    "op12_vector_codes": vectorcodes.ORACLE,
    "op13_source_mix": mixing.ORACLE,
    "quoted_chats": chat.ORACLE_QUOTED,
}
