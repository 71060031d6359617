"""Token counts behind a digest cache.

The cache is a Parquet table in a folder that all executors share,
partitioned by tokenizer version; a row is the MD5 digest of a normalised
content and its number of tokens. A tokenizer's version is the digest of its
rank file and split pattern, so a changed file never meets old counts.
Normalisation gives ends of lines as a line feed and strips white space at both
ends; counts are those of the normalised content.

Digests are joined to the cache; of the misses one text of each digest is
encoded, its count appended, and all documents joined to the counts. The
texts of the misses are shuffled once, by digest; everything else moves as
digests of 16 bytes.

Cases: a null text has a null count and is not cached; an empty or blank one
counts 0. Documents with one content share one encoding and each has its row,
repeated rows too. An empty table gives an empty result. Extra columns are
ignored. Two runs at a time may both append a digest; readers take one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.bpe import PATTERN, RANK_FILE, encode, encoding
from quillgraph.llm.common import col, documents
from quillgraph.session import scratch_path

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def tokenizer_version(rank_file: str = RANK_FILE) -> str:
    return hashlib.sha256(Path(rank_file).read_bytes() + b"\0" + PATTERN.encode()).hexdigest()[:32]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^\s+|\s+\z", "")


def _count(rank_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file)
        for batch in batches:
            n = np.fromiter((len(encode(x.as_py(), enc)) for x in batch.column(1)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer version; empty where there is no cache yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, rank_file: str = RANK_FILE) -> DataFrame:
    """``doc_id, n_tokens``; counts that ``cache`` lacks are appended to it first."""
    spark = docs.sparkSession
    version = tokenizer_version(rank_file)
    content = docs.select(col("doc_id").alias("doc_id"), normalised(col("text")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    texts = content.where(F.col("text").isNotNull()).select("digest", "text")
    misses = texts.join(read_cache(spark, cache, version), "digest", "left_anti").dropDuplicates(["digest"])
    encoded = misses.select("digest", "text").mapInArrow(_count(rank_file), "digest binary, n_tokens long")
    encoded.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return content.select("doc_id", "digest").join(read_cache(spark, cache, version), "digest", "left").select("doc_id", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents from a cache that starts empty, so nothing is carried over between runs."""
    return count_tokens(documents(spark, sf_dir), scratch_path(spark, "token-counts"))
