"""Operator 3: token counts behind a digest cache.

Counts are stored under (digest of the normalised content, digest of the tokenizer file).
A run joins the documents' digests to the stored counts, encodes each distinct missing
content once, appends the new counts to the cache and joins again.  The digest of a hot
text repeats in a third of all rows at worst: distinct digests are formed by partial
aggregation and the last join is left to the adaptive skew join (or a broadcast of checked
size), so no task gathers the copies.

Normalised content: the text's UTF-8 bytes, null as empty.  The counts depend on every byte
(the tokenizers tell blanks and letter case apart), so nothing else may be normalised away.

Cases: a null text counts as empty (0 bytes, 0 tokens); null and repeated ids give one row
for each input row; an empty table gives no rows; other columns are ignored.

The cache is append-only Parquet, partitioned by tokenizer digest.  Two runs that append the
same digest write equal counts, and readers take one of them, so a repeated or failed run
does no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .common import materialise, small_side, text_or_empty, work_dir
from .encoders import encoder, slices, tokenizer_path

_CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokenizer", T.StringType())])
#: A digest of 32 bytes, an id or a count, and the overhead of a hashed row.
_ROW_BYTES = 160


def tokenizer_digest(path: str) -> str:
    """The tokenizer's version: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version, one row for each digest."""
    try:
        stored = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException:  # no cache yet
        stored = spark.createDataFrame([], _CACHE)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _stored_rows(spark: SparkSession, cache: str, version: str) -> int:
    """Rows of the cache for one tokenizer, repeats included: a partition's row counts, from file footers alone."""
    try:
        return spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version).count()
    except AnalysisException:
        return 0


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for digests, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([len(x) // 4 for x in e.batch(texts)], pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, digest, n_bytes, n_tokens.

    ``cache``: folder of stored counts; None starts an empty one for this run.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    version, where = tokenizer_digest(tokenizer), work_dir(spark, "token-counts")
    cache = cache or f"{where}/cache"
    text = text_or_empty(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"))
    keys = materialise(source.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), f"{where}/keys")

    stored = read_cache(spark, cache, version)
    distinct = keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    missing = materialise(distinct.join(stored, "digest", "left_anti"), f"{where}/missing")
    n_missing = missing.count()
    if n_missing:
        # Texts travel only here, and only those of one row for each missing digest are kept.
        chosen = small_side(missing.select(F.col("digest"), F.col("doc_id").alias("chosen")), n_missing, _ROW_BYTES)
        same = (source["digest"] == chosen["digest"]) & source["doc_id"].eqNullSafe(chosen["chosen"])
        lacking = source.join(chosen, same, "left_semi").select("digest", "text")
        # Rows that repeat both id and text are all chosen; one count of each digest is stored.
        new = lacking.mapInArrow(_count(tokenizer), T.StructType(_CACHE.fields[:2])).dropDuplicates(["digest"])
        new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
        stored = read_cache(spark, cache, version)
    # The whole cache is the side that may be broadcast, so its size is what counts.
    counts = small_side(stored, _stored_rows(spark, cache, version), _ROW_BYTES)
    return keys.join(counts, "digest", "left").select("doc_id", "digest", "n_bytes", "n_tokens")
