"""The opN_ queries and the pipeline as the driver calls them, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder
from .decontamination import find_leaks
from .language_id import identify_languages
from .lm_scoring import score_documents
from .near_dedup import near_duplicates
from .packing import pack
from .quality_classifier import classify_quality
from .quality_rules import clean_lines
from .substring_dedup import remove_repeats
from .toxicity import score_toxicity
from .url_filters import filter_urls
from .url_list import EVENTS, FIRST_MINUTE, MINUTES, STEP


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public vocabulary; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.pmod(F.col("page_id") * STEP, F.lit(MINUTES))
    fetched = F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_MINUTE).cast("timestamp")) + minute * 60)
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    events = spark.createDataFrame(EVENTS, "list_name string, kind string, pattern string, action string, event string, listed_at string")
    out = filter_urls(captures, events)
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(_table(spark, sf_dir, "documents"), held_out=id_remainder("doc_id", 7) == 2)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"), percent=85, shingle=5)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out=1, modulus=3)
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out=2, modulus=4)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"), held_out=id_remainder("doc_id", 4) == 2)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(_table(spark, sf_dir, "documents"), tokenizer_file(), limit=2048, end_id=0, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_quality_rules": op4_quality_rules,
        "op5_toxicity": op5_toxicity,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_language_id": op7_language_id,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_best_two_fit": op10_best_two_fit,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import op1_sql, op3_sql, op4_sql, op8_sql

    return {"op1_url_filters": op1_sql(), "op3_near_duplicates": op3_sql(), "op4_quality_rules": op4_sql(), "op8_substring_dedup": op8_sql()}
