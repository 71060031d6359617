"""The knowledge base as Parquet tables: keyed upserts, lookups, as-of reads and the query cache.

A table is a folder of immutable versions; a write puts a new version beside
the old one and then swaps a pointer file, so readers never see half a write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.session import spread

DOCUMENTS = "id string, path string, doc_type string, ingested_at timestamp, char_count long, metadata map<string,string>"
ENTITIES = "id string, name string, entity_type string, aliases array<string>, description string, created_at timestamp"
FACTS = "id string, subject_id string, predicate string, object_id string, object_value string, context string, source_doc string, source_page int, confidence double, ingested_at timestamp, valid_from timestamp, valid_until timestamp, is_active boolean"
QUERY_CACHE = "query_hash string, query_text string, answer string, reasoning string, confidence double, kb_version string, created_at timestamp, ttl_seconds long"
SCHEMAS = {"documents": DOCUMENTS, "entities": ENTITIES, "facts": FACTS, "query_cache": QUERY_CACHE}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and the last of each key in ``new`` (by ``order``)."""
    if order:
        new = new.withColumn("__last", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__last = 1").drop("__last")
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """By name: a known name keeps its id and takes everything else, nulls too, from ``new``."""
    known = old.select("name", F.col("id").alias("__id"))
    kept = new.join(known, "name", "left").withColumn("id", F.coalesce("__id", "id")).drop("__id").select(*new.columns)
    return upsert(old, kept, ["name"])


def new_documents(documents: DataFrame, known: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents to ingest: those without a stored document that has facts."""
    done = known.join(facts.select(F.col("source_doc").alias("path")).distinct(), "path", "left_semi").select("id")
    return documents.join(done, "id", "left_anti")


def unseen(segments: DataFrame, hashes: DataFrame, content: str = "content") -> DataFrame:
    """Segments whose normalised content has no hash among ``hashes`` (a column ``content_hash``), one of each content."""
    from quillgraph.functions.text import content_hash

    new = segments.withColumn("content_hash", content_hash(F.col(content))).join(hashes.select("content_hash").distinct(), "content_hash", "left_anti")
    order = Window.partitionBy("content_hash").orderBy(*[c for c in segments.columns if c != content])
    return new.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def hydrate(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """The facts of ``ids`` (a column ``id``)."""
    # A semi-join is pushed below a union of facts: as many joins, and their sorts, in each task.
    return spread(facts, "id").join(spread(ids.select("id"), "id").distinct().hint("merge"), "id").select(*facts.columns)


def delete_document(documents: DataFrame, facts: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    return documents.where(F.col("path") != path), facts.where(F.col("source_doc") != path)


def invalidate(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """``facts`` with those of ``ids`` (a column ``id``) switched off."""
    off = ids.select("id", F.lit(True).alias("__off")).distinct()
    return facts.join(off, "id", "left").withColumn("is_active", F.col("is_active") & F.col("__off").isNull()).drop("__off").select(*facts.columns)


def as_of(facts: DataFrame, subjects: DataFrame | None, at: Column) -> DataFrame:
    """Facts valid at a time, in half-open intervals with open ends for nulls; ``subjects`` has ``subject_id``."""
    valid = facts.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
    return valid if subjects is None else valid.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")


def active(facts: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    return facts.where(F.col("is_active") & (F.col("confidence") >= min_confidence))


def stats(**tables: DataFrame) -> DataFrame:
    """``name, n`` of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


def with_object(facts: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """Facts with the name of their object as ``name``; those without an object are spread by subject."""
    o = entities.select(F.col("id").alias("__k"), F.col("id").alias("object_id"), F.col("name").alias(name))
    keyed = facts.withColumn("__k", F.coalesce("object_id", F.concat_ws(":", F.lit(""), "subject_id", "predicate")))
    return spread(keyed, "__k", "object_id").join(spread(o, "__k", "object_id").hint("merge"), ["__k", "object_id"], "left").drop("__k")


def with_names(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with ``subject_name`` and ``object_name``; an unknown id stands for itself, none is "unknown"."""
    s = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("__s"))
    # The subject last: what goes on by subject needs no further shuffle.
    named = spread(with_object(facts, entities, "__o"), "subject_id").join(spread(s, "subject_id").hint("merge"), "subject_id", "left")
    return named.select(*facts.columns, F.coalesce("__s", "subject_id", F.lit("unknown")).alias("subject_name"), F.coalesce("__o", "object_id").alias("object_name"))


def reverse_lookup(facts: DataFrame, entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts whose object holds a text, by value or by the object's name, for ``wanted`` of (qid, predicate, needle).

    Predicates are matched by equality, and the lookups are broadcast: a shuffle
    by predicate would put all facts of one into a task. Case is ignored in the needle.
    """
    hit = with_object(facts.join(F.broadcast(wanted), "predicate"), entities, "object_name")
    n = F.lower("needle")
    return hit.where(F.contains(F.lower(F.coalesce("object_value", F.lit(""))), n) | F.contains(F.lower(F.coalesce("object_name", F.lit(""))), n))


def cache_key(query: Column, hops: Column, min_confidence: Column, at: Column, top_k: Column, version: Column) -> Column:
    """Every parameter that changes an answer, and the version of the knowledge base."""
    return F.sha2(F.concat_ws(":", query, hops.cast("string"), min_confidence.cast("string"), F.coalesce(at.cast("string"), F.lit("None")), top_k.cast("string"), version), 256)


def cached(cache: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Answers of ``wanted`` (with ``query_hash``) that have not outlived their time; the latest of each."""
    fresh = cache.where(F.col("created_at") + F.make_dt_interval(secs=F.col("ttl_seconds")) > now)
    latest = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("query_hash").orderBy(F.col("created_at").desc()))).where("__n = 1").drop("__n")
    return wanted.join(latest, "query_hash")


class Store:
    """Versioned tables of one knowledge base in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, table: str):
        return self._path(f"{self.folder}/{table}/CURRENT")

    def version(self, table: str) -> str | None:
        at = self._pointer(table)
        if not self._fs.exists(at):
            return None
        rows = self.spark.read.text(at.toString()).collect()
        return rows[0][0] if rows else None

    def read(self, table: str) -> DataFrame:
        v = self.version(table)
        if v is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{table}/{v}")

    def write(self, table: str, df: DataFrame) -> str:
        """Replace a table; facts are laid out by subject, so that lookups prune row groups."""
        v = f"v-{uuid.uuid4().hex}"
        cols = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        out = df.select(*cols)
        if table == "facts":
            out = out.repartition("subject_id").sortWithinPartitions("subject_id", "predicate")
        out.write.parquet(f"{self.folder}/{table}/{v}")
        stream = self._fs.create(self._path(f"{self.folder}/{table}/.CURRENT-{v}"), True)
        stream.write(bytearray(v.encode()))
        stream.close()
        # One step for readers: the pointer is there before and after.
        jvm = self.spark.sparkContext._jvm
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        here = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        here.rename(self._path(f"{self.folder}/{table}/.CURRENT-{v}"), self._pointer(table), options)
        return v

    def delete(self) -> None:
        self._fs.delete(self._path(self.folder), True)
