"""The queries opN_<name> over whole tables: each reads its table, runs its operator and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.llm import embedding_dedup, jaccard_join, language_id, license_scan, mixing, packing, quality_cnn, quality_rules, substring_dedup, toxicity
from logsluice.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(parts: int, part: int, id_col: str = "doc_id") -> Column:
    """Rows that no model learns from; a null id belongs to neither side, so it is not learnt from either."""
    return F.crc32(F.col(id_col).cast("string")) % parts == part


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = language_id.training_texts(docs.where(~held_out(4, 2)))
    return language_id.identify(docs, texts).select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan.scan(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size("sentence_ids").cast("long").alias("n_sentences"), F.size("unmatched").cast("long").alias("n_unmatched"),
    )


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = toxicity.score(docs, toxicity.train(docs, labels.where(~held_out(5, 0))))
    return got.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = quality_cnn.classify(docs, quality_cnn.train(docs, labels.where(~held_out(4, 2))))
    return got.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


__all__ = ["ORACLES", "QUERIES"]
