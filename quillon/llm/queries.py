"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, licenses, line_dedup, minhash, passages, quality, sharding, url_filter
from .common import pinned
from .sql import ORACLE


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each place: doc_id, license, n_words, n_matched, start, end."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs).select("doc_id", F.explode("licenses").alias("x"))
    return found.select("doc_id", "x.license", "x.n_words", "x.n_matched", F.col("x.start").alias("start_char"), F.col("x.end").alias("end_char"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.apply_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.assign_shards(docs)


def op5_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.share_vocabulary(spark, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT id AS turn, bigint(-7) AS conv_id, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = chat.format_chats(turns.unionByName(extra))
    seen = pinned(done, "conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return seen.select("conv_id", F.size("t").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words and more, wherever they start in a line."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.dedup_passages(docs).select("doc_id", "n_words", "n_cut", "text")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, k=3, percent=85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item it contains: doc_id, item_id, n_shingles, n_shared."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_benchmark(docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.item_id", "x.n_shingles", "x.n_shared")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_license_scans": op2_license_scans,
        "op3_quality_rules": op3_quality_rules,
        "op4_sharding": op4_sharding,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_line_dedup": op7_line_dedup,
        "op7_passage_dedup": op7_passage_dedup,
        "op8_minhash_dedup": op8_minhash_dedup,
        "op9_language_id": op9_language_id,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {k: v() if callable(v) else v for k, v in ORACLE.items()}
