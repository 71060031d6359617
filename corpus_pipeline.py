"""From raw documents to a tokenised training order, in five written stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet to the shared folder and hands the reread table on, so a
lost executor costs at most the stage it worked on. All stages but the last
return the columns of ``documents``; the last adds ``tokens``, ``n_tokens``,
``round_trip``, whether the tokens decode to the text byte by byte, and
``training_order``, a number that grows along the order of the mixing stage.

Mixing range-sorts the documents and writes them in that order, a file to a
range; a reader packs files as it likes, so the order is kept as a column: the
number of the file and the row in it, from the metadata of the Parquet source.
Numbers are distinct and have gaps between files. A frame that was not read
from files is numbered in its own order.

Cases: null and blank texts are rejected by the quality rules. Repeated rows
and exact copies leave one row, that of the smallest ``doc_id`` (a null
``doc_id`` comes last); such a row is kept if it is the only one with its
text. A null source is a source of its own. Very long texts are read whole.
An empty table gives an empty table. Extra columns are carried along; those
named as what the last stage adds are replaced by it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.bpe import bpe_encode
from quillgraph.llm.common import col, documents
from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.mixing import mix
from quillgraph.llm.quality import quality_filter
from quillgraph.llm.simhash import near_dedup
from quillgraph.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, keep_all=True)


def training_order(docs: DataFrame) -> Column:
    """The place of each row of ``docs`` in the order in which it was written."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    # part-00012-<write>-c000: the partition that wrote the file, and the file among those of the partition.
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    return F.shiftleft(number(r"^part-(\d+)"), 42) + F.shiftleft(number(r"-c(\d+)\."), 32) + F.col("_metadata.row_index")


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = [c for c in docs.columns if c.lower() != "training_order"]
    return bpe_encode(docs.select(*[col(c) for c in kept], training_order(docs).alias("training_order")), verify=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: Near-dedup closes groups of approximate neighbours and BPE merges by rank:
#: neither is SQL. tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
