"""Relational tables as entities and facts, without a language model.

A fact is an edge (``object_id``) or a literal (``object_value``), with
provenance, a confidence in [0, 1], and a half-open interval of validity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACT_COLUMNS = ["id", "subject_id", "predicate", "object_id", "object_value", "source_doc", "confidence", "valid_from", "valid_until", "is_active"]
ENTITY_COLUMNS = ["id", "name", "entity_type", "aliases"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def graded(column: str) -> Column:
    """A confidence between 0.40 and 0.99 that follows from a key."""
    return F.round(F.lit(0.4) + (F.col(column) % 60) / 100, 2)


def map_facts(df: DataFrame, fact_id: Column, subject: Column, predicate: str, *, edge: Column | None = None, value: Column | None = None, source: str, confidence: Column, valid_from: Column | None = None, valid_until: Column | None = None, active: Column | None = None) -> DataFrame:
    """One fact for each row of ``df``."""
    none = F.lit(None)
    return df.select(
        fact_id.alias("id"), subject.alias("subject_id"), F.lit(predicate).alias("predicate"),
        (none if edge is None else edge).cast("string").alias("object_id"), (none if value is None else value).cast("string").alias("object_value"),
        F.lit(source).alias("source_doc"), confidence.cast("double").alias("confidence"),
        (none if valid_from is None else valid_from).cast("timestamp_ntz").alias("valid_from"), (none if valid_until is None else valid_until).cast("timestamp_ntz").alias("valid_until"),
        (F.lit(True) if active is None else active).alias("is_active"),
    )


def geo_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in nations, nations in regions; segments as literals."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    return (
        map_facts(c, key("cl", "c_custkey"), key("c", "c_custkey"), "is located in", edge=key("n", "c_nationkey"), source="customer", confidence=graded("c_custkey"))
        .unionByName(map_facts(c, key("cs", "c_custkey"), key("c", "c_custkey"), "has segment", value=F.col("c_mktsegment"), source="customer", confidence=F.lit(0.8), active=F.col("c_custkey") % 7 != 0))
        .unionByName(map_facts(s, key("sl", "s_suppkey"), key("s", "s_suppkey"), "is located in", edge=key("n", "s_nationkey"), source="supplier", confidence=graded("s_suppkey")))
        .unionByName(map_facts(n, key("nr", "n_nationkey"), key("n", "n_nationkey"), "is part of", edge=key("r", "n_regionkey"), source="nation", confidence=F.lit(1.0)))
    )


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return map_facts(o, key("op", "o_orderkey"), key("o", "o_orderkey"), "was placed by", edge=key("c", "o_custkey"), source="orders", confidence=graded("o_orderkey"), valid_from=F.col("o_orderdate")).unionByName(
        map_facts(o, key("os", "o_orderkey"), key("o", "o_orderkey"), "has status", value=F.col("o_orderstatus"), source="orders", confidence=F.lit(0.7), valid_from=F.col("o_orderdate"))
    )


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return map_facts(p, key("pb", "p_partkey"), key("p", "p_partkey"), "has brand", value=F.col("p_brand"), source="part", confidence=F.lit(0.9)).unionByName(
        map_facts(p, key("pt", "p_partkey"), key("p", "p_partkey"), "is", value=F.col("p_type"), source="part", confidence=F.lit(0.6))
    )


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user did last, valid until the next event."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return map_facts(e, key("ev", "event_id"), key("u", "user_id"), "did", value=F.col("event_type"), source="events", confidence=graded("event_id"), valid_from=F.col("ts"), valid_until=F.col("next"))


def all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_facts(spark, sf_dir).unionByName(order_facts(spark, sf_dir)).unionByName(part_facts(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n, r, p = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region", "part"))
    one = lambda df, prefix, k, name, kind: df.select(key(prefix, k).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"), F.array(F.replace(F.lower(F.col(name)), F.lit("#"), F.lit(" "))).alias("aliases"))
    return one(c, "c", "c_custkey", "c_name", "customer").union(one(s, "s", "s_suppkey", "s_name", "supplier")).union(one(n, "n", "n_nationkey", "n_name", "nation")).union(one(r, "r", "r_regionkey", "r_name", "region")).union(one(p, "p", "p_partkey", "p_name", "part"))


_SQL_FACT = "SELECT {id} AS id, {s} AS subject_id, '{p}' AS predicate, CAST({o} AS VARCHAR) AS object_id, CAST({v} AS VARCHAR) AS object_value, '{t}' AS source_doc, CAST({c} AS DOUBLE) AS confidence, CAST({f} AS TIMESTAMP) AS valid_from, CAST({u} AS TIMESTAMP) AS valid_until, {a} AS is_active FROM {t}{x}"


def _sql(t: str, i: str, k: str, s: str, p: str, *, o: str = "NULL", v: str = "NULL", c: str | None = None, f: str = "NULL", u: str = "NULL", a: str = "true", x: str = "") -> str:
    grade = f"round(0.4 + ({k} % 60) / 100.0::DOUBLE, 2)"
    return _SQL_FACT.format(id=f"'{i}:' || {k}", s=s, p=p, o=o, v=v, t=t, c=grade if c is None else c, f=f, u=u, a=a, x=x)


#: The same facts and entities for the SQL oracles.
FACTS_SQL = " UNION ALL ".join([
    _sql("customer", "cl", "c_custkey", "'c:' || c_custkey", "is located in", o="'n:' || c_nationkey"),
    _sql("customer", "cs", "c_custkey", "'c:' || c_custkey", "has segment", v="c_mktsegment", c="0.8", a="c_custkey % 7 <> 0"),
    _sql("supplier", "sl", "s_suppkey", "'s:' || s_suppkey", "is located in", o="'n:' || s_nationkey"),
    _sql("nation", "nr", "n_nationkey", "'n:' || n_nationkey", "is part of", o="'r:' || n_regionkey", c="1.0"),
    _sql("orders", "op", "o_orderkey", "'o:' || o_orderkey", "was placed by", o="'c:' || o_custkey", f="o_orderdate"),
    _sql("orders", "os", "o_orderkey", "'o:' || o_orderkey", "has status", v="o_orderstatus", c="0.7", f="o_orderdate"),
    _sql("part", "pb", "p_partkey", "'p:' || p_partkey", "has brand", v="p_brand", c="0.9"),
    _sql("part", "pt", "p_partkey", "'p:' || p_partkey", "is", v="p_type", c="0.6"),
])
EVENT_FACTS_SQL = _sql("events", "ev", "event_id", "'u:' || user_id", "did", v="event_type", f="ts", u="lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
ENTITIES_SQL = " UNION ALL ".join(
    f"SELECT '{x}:' || {k} AS id, {n} AS name, '{t}' AS entity_type, [replace(lower({n}), '#', ' ')] AS aliases FROM {t}"
    for t, x, k, n in (("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"), ("nation", "n", "n_nationkey", "n_name"), ("region", "r", "r_regionkey", "r_name"), ("part", "p", "p_partkey", "p_name"))
)
