"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of the text digests, one per partition and then summed,
name every digest with more than ``2 n / (k + 1)`` of the ``n`` rows among at
most ``k + 1`` candidates. A second pass counts the candidates exactly and
picks their winners; those, at most ``k + 1`` rows of a fixed size, are
broadcast, and all other copies of a frequent text leave on the map side. The
rest is shuffled by digest as usual, without a key that could be hot.

Which row stays: of each text the one with the smallest ``doc_id`` (null last,
then by a hash of all columns). Texts are compared as they are, by 128-bit
MD5; an empty text is a text like any other. Null texts have nothing to
compare and all stay, each a copy of none. Repeated rows are copies. An empty
table gives an empty table; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import col, columns, documents, fresh
from quillgraph.session import materialise

COUNTERS = 1024


def shrink(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """A mergeable Misra-Gries summary cut back to ``k`` counters: all lose the (k+1)-th largest."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {d: c - cut for d, c in counts.items() if c > cut}


def misra_gries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        n = 0
        for batch in batches:
            n += batch.num_rows
            for x in batch.column(0).value_counts():
                d = x["values"].as_py()
                counts[d] = counts.get(d, 0) + x["counts"].as_py()
            counts = shrink(counts, k)
        # The null digest carries the number of rows seen.
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.binary()), pa.array([n, *counts.values()], pa.int64())], ["digest", "n"])

    return run


def frequent(summaries: DataFrame, k: int, least: int = 1) -> list[bytes]:
    """What partitions' summaries (``digest, n``; the null digest has the rows seen) name as frequent: ``k + 1`` at most.

    Every digest in more than ``2 n / (k + 1)`` rows, and in over ``least``, is among them, and none in ``n / (k + 1)`` or fewer.
    """
    # A few counters for each partition; written, so that the texts are read once for them.
    total = materialise(summaries.groupBy("digest").agg(F.sum("n").alias("n")), "frequent")
    # Summed counters fall short of the truth by n / (k + 1) at most, so a
    # counter above that bound is kept and the kept ones number k + 1 at most.
    bound = total.where(F.col("digest").isNull()).select((F.col("n") / (k + 1)).alias("bound"))
    over = total.join(F.broadcast(bound), (F.col("n") > F.col("bound")) & (F.col("n") > least) & F.col("digest").isNotNull())
    return [bytes(r["digest"]) for r in over.collect()]


def frequent_digests(digests: DataFrame, k: int = COUNTERS) -> list[bytes]:
    """Candidates for heavy hitters among a one-column frame of digests."""
    return frequent(digests.mapInArrow(misra_gries(k), "digest binary, n long"), k)


def exact_dedup(docs: DataFrame, k: int = COUNTERS, copies: str | None = None) -> DataFrame:
    """One row of each text; ``copies`` names a column for the number of rows that had it."""
    spark = docs.sparkSession
    digest_, n_, first_, rank_, tie_, text_ = fresh(docs, "digest", "n", "first", "rank", "tie", "hastext")
    hashable = [col(f.name) for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    # What is known of a text before the shuffle, so that texts travel only where they are asked for.
    df = docs.withColumn(digest_, F.unhex(F.md5(col("text")))).withColumn(text_, col("text").isNotNull()).withColumn(tie_, F.xxhash64(*hashable))
    hot = frequent_digests(df.where(col("text").isNotNull()).select(digest_), k)
    candidates = spark.createDataFrame([(d,) for d in hot], f"`{digest_}` binary")
    heavy = (
        df.select(digest_, "doc_id").join(F.broadcast(candidates), digest_)
        .groupBy(digest_).agg(F.count("*").alias(n_), F.min("doc_id").alias(first_))
    )
    # At most k + 1 rows of some 40 bytes, whatever the input.
    left = df.join(F.broadcast(heavy), digest_, "left").where(col(n_).isNull() | col("doc_id").eqNullSafe(col(first_)))
    # Null texts are spread by a hash of their row; nothing is dropped among them.
    left = left.withColumn(digest_, F.coalesce(col(digest_), F.unhex(F.md5(col(tie_).cast("string")))))
    by = Window.partitionBy(digest_)
    order = by.orderBy(col(text_).desc(), col("doc_id").asc_nulls_last(), col(tie_))
    ranked = left.withColumn(rank_, F.row_number().over(order))
    if copies:
        same = F.count_if(col(text_)).over(by)
        ranked = ranked.withColumn(n_, F.when(~col(text_), 1).otherwise(F.coalesce(col(n_), same)))
    kept = ranked.where(~col(text_) | (col(rank_) == 1))
    out = columns(docs)
    return kept.select(*out, col(n_).alias(copies)) if copies else kept.select(*out)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"), copies="copies").select("doc_id", "copies")


ORACLE_SQL = """
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT doc_id, 1 AS copies FROM documents WHERE text IS NULL"""
