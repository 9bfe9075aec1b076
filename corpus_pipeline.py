"""Documents to training sequences: quality rules, line dedup, near-copy removal, source mix, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each one's
result as Parquet in the shared folder and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryfield.llm import line_dedup, mixing, packing, quality, simhash
from quarryfield.llm.common import materialise, work_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep(docs).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly, go; documents stay."""
    return _columns(line_dedup.dedup_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    return simhash.distinct_documents(docs, shingle=5, min_similarity=0.8).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the source weights give it; copies keep the document's id."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in a sequence of at most 1,024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("source mix", mix_sources),
    ("best-fit packing", pack),
]

#: Tokenising and Newton's method have no SQL form; tests/llm/test_pipeline.py checks against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialise(stage(spark, docs, sf_dir), f"{where}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
