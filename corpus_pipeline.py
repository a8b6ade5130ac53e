"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage reads what the one before it wrote and returns a DataFrame; all but the last return the columns of
documents, with the texts and rows that their decisions leave. No other column is carried. Empty tables on either side
give empty tables of the same columns, rows may repeat, and texts are read whole whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontam, line_dedup, minhash, quality
from quillon.llm.common import Work

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, the others keep the lines that pass; n_chars follows the text.

    A null, empty or short text (fewer than 50 words) is rejected. Repeated rows are judged alike; ids don't matter.
    """
    judged = quality.apply_quality(docs).where("kept").withColumn("text", F.col("clean_text"))
    return judged.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document that loses all its text this way goes with them.

    The occurrence in the least id comes first, a null id before all; rows with one id and text are one document and
    lose the same. A null or blank text has no windows and stays.
    """
    clean = line_dedup.dedup_lines(docs)
    left = clean.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more.

    That of the least id stays. Rows that share an id are linked with others, and go, together; if their id stays, so
    does one row of each group of near-duplicates among them. Documents without words, and all rows with a null id, stay.
    """
    return minhash.drop_near_duplicates(docs, k=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go: four fifths of its five-word shingles, anywhere in the text.

    Null texts and wordless items contain nothing and are in nothing. Repeated rows go or stay together.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_benchmark(docs, benchmark).where(F.size("items") == 0).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, packed, and whether they decode to the text again. A null text has no tokens."""
    import public_tokenizers

    vocabulary = bpe.share_vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(docs.select(*COLUMNS), vocabulary, decoded=True)
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "tokens", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", tokenise),
]

#: Two stages (near-dedup beyond small tables, byte-level BPE) are not for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = work.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
