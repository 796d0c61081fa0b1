"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import clustered
from .common import fold, new_path, read
from .kneser_ney import scored
from .langid import identify
from .mixing import blocks, words
from .mpeg_audio import media_features, media_table
from .ngram_join import ngram_components
from .packing import packed
from .page_diff import extracted
from .quality import COUNTS, assessed
from .sharding import ShardStore
from .token_counts import token_counts
from .toxicity import toxicity
from .whitening import whitened


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"), n=5, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals, compaction, and the rows as the last version holds them."""
    docs = read(spark, sf_dir, "documents")
    store = ShardStore(spark, new_path(spark, "shards"), docs.schema)
    for arrival in (0, 1):
        store.append(docs.where(fold(F.col("doc_id"), 2) == arrival))
    store.settle()
    store.vacuum()
    return store.read().select(
        "doc_id", "lang", "source", "n_chars", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(read(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = media_features(media_table(read(spark, sf_dir, "documents")))
    return features.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "feature", "frames", "duration_us", "crc_checked", "crc_failed")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(read(spark, sf_dir, "documents"))
    return rows.select(
        "_doc.doc_id", "_doc.source", words(F.col("_doc.text")).alias("n_tokens"), F.round("weight", 9).alias("weight"), "copies", F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"))


def op11_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_sharding": """
            SELECT doc_id, lang, source, n_chars, coalesce(strlen(text), 0) AS n_bytes, md5(coalesce(text, '')) AS text_md5
            FROM documents""",
    }
