"""BM25 over documents and over entities, many queries at a time.

Postings are grouped on the map side by (document, term), and only terms that
a query has are joined; the corpus statistics are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import discard, materialise, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Pairs of query and document that a task scores, and the number of tasks beyond which it scores more.
PAIRS, MAX_PARTS = 500_000, 10_000


def alnum_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))


def space_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def entity_text(name: Column, aliases: Column) -> Column:
    return F.concat_ws(" ", name, F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), " "))


def query_terms(queries: DataFrame, terms) -> DataFrame:
    """``qid, term, qtf``: a repeated query term counts repeatedly."""
    return queries.select("qid", F.explode(terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """``qid, id, score, rank`` from ``id, text`` and ``qid, text``; only positive scores.

    idf = max(0, ln((N - df + 0.5) / (df + 0.5) + 1)) on alphanumeric terms.
    Documents without a text count in N, not in their mean length.

    Texts are read once; what is written holds the counts of the queries' terms, and
    under the term "" the lengths of all documents. The terms of the queries are broadcast.
    All that belongs to an id is then scored in one task, so pairs of query
    and id, far more than there are counts, are never shuffled.
    """
    q = query_terms(queries, alnum_terms)
    wanted = q.select("term").distinct().union(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    t = docs.select("id", alnum_terms(F.col("text")).alias("terms"))
    held = F.concat(F.array(F.lit("")), F.coalesce("terms", F.array().cast("array<string>")))
    found = t.select("id", F.array_size("terms").alias("dl"), F.explode(held).alias("term")).join(F.broadcast(wanted), "term", "left_semi")
    counts = materialise(found.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    tf, lengths = counts.where("term <> ''"), counts.where("term = ''")
    n, avgdl = lengths.agg(F.coalesce(F.sum("tf"), F.lit(0)), F.sum(F.col("dl") * F.col("tf")) / F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).first()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(0.0), F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    asked = q.join(df, "term").select("qid", "term", (F.col("qtf") * idf).alias("weight"))
    weight = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl).cast("double")))
    parts = min(n * q.select("qid").distinct().count() // PAIRS, MAX_PARTS)
    hits = spread(tf, "id", least=parts).join(F.broadcast(asked), "term").groupBy("qid", "id").agg(F.round(F.sum(weight), 6).alias("score")).where("score > 0")
    best = materialise(_ranked(hits, k), "best")
    discard(counts)
    return best


def search_entities(entities: DataFrame, queries: DataFrame, k: int = 5, positive_only: bool = True) -> DataFrame:
    """``qid, id, score, rank`` under Okapi BM25 with its floor for common terms.

    idf = ln(N - df + 0.5) - ln(df + 0.5), where it is negative ``EPSILON``
    times the mean idf of all terms. Without ``positive_only`` entities that
    match nothing follow with score 0, by id.
    """
    q = query_terms(queries, space_terms)
    t = entities.select("id", space_terms(entity_text(F.col("name"), F.col("aliases"))).alias("terms"))
    size = t.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    tf = t.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(size.select("n")).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    floor = df.agg((EPSILON * F.round(F.avg("raw"), 9)).alias("floor"))
    idf = df.crossJoin(floor).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = tf.join(q, "term").join(idf, "term").crossJoin(size.select("avgdl")).groupBy("qid", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    if positive_only:
        return _ranked(hits.where("score > 0"), k)
    every = queries.select("qid").crossJoin(entities.select("id")).join(hits, ["qid", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return _ranked(every, k)


def fuse_seeds(ranked: DataFrame, entities: DataFrame, k: int = 3, cap: int = 10) -> DataFrame:
    """``qid, id, score``: ranks of a question's parts added up, (k - rank + 1) / k each.

    ``ranked`` is ``qid, part, id, rank``. The cap is 2 n for the n > cap / 2
    parts of a question of three parts or more; ids without an entity drop out after it.
    """
    parts = ranked.groupBy("qid").agg(F.count_distinct("part").alias("parts"))
    total = ranked.where(F.col("rank") <= k).groupBy("qid", "id").agg(F.round(F.sum((k - F.col("rank") + 1) / k), 6).alias("score"))
    limit = F.when(F.col("parts") >= 3, F.greatest(F.lit(cap), 2 * F.col("parts"))).otherwise(cap)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id").asc())
    kept = total.join(parts, "qid").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return kept.join(entities.select("id"), "id", "left_semi").select("qid", "id", "score", "rank")
