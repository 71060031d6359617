"""From candidate facts to a ranked, budgeted fact set for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import TOKENS_PER_WORD, overlap, rank_keywords, words
from quillgraph.session import materialise, spread

BUDGET = 600


def candidates(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """``qid`` and facts that start at an edge's source or end at its target; ``edges`` is ``qid, src, dst``.

    Literal facts come in by their subject. Facts are told apart by id, so an
    edge met twice adds nothing.
    """
    by_subject = edges.select("qid", F.col("src").alias("subject_id")).distinct().join(facts, "subject_id").select("qid", *facts.columns)
    by_object = edges.select("qid", F.col("dst").alias("object_id")).distinct().join(facts, "object_id").select("qid", *facts.columns)
    return by_subject.union(by_object).dropDuplicates(["qid", "id"])


def dedup(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The most confident fact for each statement; of equals the first id."""
    statement = F.concat(F.coalesce("object_id", F.lit("")), F.lit("\u0001"), F.coalesce("object_value", F.lit("")))
    order = Window.partitionBy(*(by or []), "subject_id", "predicate", statement).orderBy(F.col("confidence").desc(), "id")
    return facts.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def most_lines(budget: int) -> int:
    """No more lines than this fit ``budget``: each has three words besides its names."""
    return int(budget / (3 * TOKENS_PER_WORD)) + 1


def rank(facts: DataFrame, questions: DataFrame, most: int | None = None) -> DataFrame:
    """``qid`` and facts with names, by keyword overlap, confidence, recency and id: ``overlap``, ``rank``.

    With ``most`` the first so many of each question, and after them only lines
    that cost nothing (their names are null) with a rank too low. Without it no
    task holds a question: facts are sorted by ranges into a written table, and
    the rows of the ranges before are added to a row's number in its own.
    """
    q = questions.select("qid", rank_keywords(F.col("text")).alias("__k"))
    blob = F.lower(F.concat_ws(" ", "subject_name", "predicate", F.coalesce("object_value", "object_name")))
    scored = facts.join(q, "qid").withColumn("overlap", overlap(F.col("__k"), blob)).drop("__k")
    newest = [F.col("ingested_at").desc_nulls_last()] if "ingested_at" in facts.columns else []
    order = [F.col("overlap").desc(), F.col("confidence").desc(), *newest, F.col("id").asc()]
    if most is not None:
        # Rows are let go before the shuffle; a line that costs nothing is alone in its group and stays.
        free = F.when(F.col("subject_name").isNull() | F.col("predicate").isNull(), F.col("id"))
        first = scored.withColumn("__n", F.row_number().over(Window.partitionBy("qid", free).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
        return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    ranges = materialise(scored.repartitionByRange("qid", *order).withColumn("__p", F.spark_partition_id()), "ranking")
    before = Window.partitionBy("qid").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("qid", "__p").count().select("qid", "__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    numbered = spread(ranges, "qid", "__p").withColumn("__n", F.row_number().over(Window.partitionBy("qid", "__p").orderBy(*order)))
    return numbered.join(F.broadcast(starts), ["qid", "__p"]).withColumn("rank", (F.col("__before") + F.col("__n")).cast("int")).select(*scored.columns, "rank")


def render(label, subject, predicate, obj):
    return F.concat(F.lit("F"), label.cast("string"), F.lit(": "), subject, F.lit(" -- "), predicate, F.lit(" --> "), F.coalesce(obj, F.lit("unknown")))


def trim(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The longest prefix by rank whose lines cost ``budget`` tokens at most, with ``line`` and ``spent``."""
    line = render(F.col("rank"), F.col("subject_name"), F.col("predicate"), F.coalesce("object_value", "object_name"))
    n = F.size(words(F.col("line")))
    running = F.sum(n).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("line", line).withColumn("spent", F.round(running * TOKENS_PER_WORD, 1)).where(F.col("spent") <= budget)


def assemble(edges: DataFrame, facts: DataFrame, entities: DataFrame, questions: DataFrame, min_confidence: float = 0.5, budget: int = BUDGET) -> DataFrame:
    from quillgraph.operators.store import active, with_names

    kept = dedup(active(candidates(edges, facts), min_confidence), ["qid"])
    return trim(rank(with_names(kept, entities), questions, most_lines(budget)), budget)
