"""From a fact set to an answer: what needs no model, and the frame around the one that does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import FILLER_WORDS, FILTER_STOPWORDS, PREPOSITIONS, classify_task, filter_keywords, overlap, question_marks, starts_upper_or_digit, strip_fences, words

TASK_TOKENS = {"factoid": 600, "summary": 900, "plan": 900, "analogy": 600, "multi_question": 1000}
DIRECT_CONFIDENCE = 0.85
CONTEXT_CHARS = 160


def render_fact(label: Column, subject: Column, predicate: Column, value: Column, name: Column, context: Column) -> Column:
    """A value before a name; a fact without an object shows where it was said."""
    obj = F.coalesce(F.when(F.trim(value) != "", value), name)
    head = F.concat(F.lit("F"), label.cast("string"), F.lit(": "), subject, F.lit(" -- "), predicate)
    said = F.trim(F.coalesce(context, F.lit("")))
    cut = F.when(F.length(said) > CONTEXT_CHARS, F.concat(F.rtrim(F.substring(said, 1, CONTEXT_CHARS - 1)), F.lit("..."))).otherwise(said)
    missing = obj.isNull() | F.trim(obj).isin("", "?", "unknown")
    return F.when(missing & (said != ""), F.concat(head, F.lit(" (context: "), cut, F.lit(")"))).otherwise(F.concat(head, F.lit(" --> "), F.coalesce(obj, F.lit("?"))))


def filter_facts(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """Facts that share a keyword with their question; all of them where none does, or where a multi-part question keeps under five."""
    q = questions.select("qid", filter_keywords(F.col("text")).alias("__k"), (classify_task(F.col("text")) == "multi_question").alias("__m"))
    blob = F.lower(F.concat_ws(" ", "subject_name", "predicate", F.coalesce("object_value", "object_name"), "context"))
    per = Window.partitionBy("qid")
    scored = facts.join(q, "qid").withColumn("overlap", overlap(F.col("__k"), blob)).withColumn("__hits", F.count_if(F.col("overlap") > 0).over(per))
    everything = (F.col("__hits") == 0) | (F.col("__m") & (F.col("__hits") < 5))
    return scored.where((F.col("overlap") > 0) | everything).drop("__k", "__m", "__hits")


def direct_answers(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, answer, fact_id, confidence`` where one confident fact alone shares words with the question in subject and predicate."""
    q = questions.where(classify_task(F.col("text")) == "factoid").select("qid", filter_keywords(F.col("text")).alias("__k"))
    hit = facts.join(q, "qid").where(F.col("confidence") >= DIRECT_CONFIDENCE)
    hit = hit.where((overlap(F.col("__k"), F.lower("subject_name")) > 0) & (overlap(F.col("__k"), F.lower("predicate")) > 0))
    alone = hit.withColumn("__n", F.count("*").over(Window.partitionBy("qid"))).where("__n = 1")
    answer = F.coalesce(F.when(F.col("object_value") != "", F.col("object_value")), F.col("object_name"))
    return alone.select("qid", answer.alias("answer"), F.col("id").alias("fact_id"), "confidence").where("answer <> '?'")


def confidence(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """``qid, confidence`` of ``answers`` (qid, question, answer) over ``facts`` (qid, names, confidence, context).

    The mean of the facts' confidences, a bonus for their number, and penalties
    for fragments, short answers, answers beside the question or beyond the
    facts, and parts of a question that are not covered.
    """
    blob = F.lower(F.concat_ws(" ", "subject_name", "predicate", "object_value", "object_name", "context"))
    # Which content words of the answer any fact holds: one aggregate, no text is concatenated.
    a = answers.select(
        "qid", "question", "answer",
        F.filter(F.regexp_extract_all(F.lower("answer"), F.lit("([a-z0-9]+)")), lambda w: (F.length(w) > 4) & ~w.isin(*FILTER_STOPWORDS) & ~w.isin(*FILLER_WORDS)).alias("content"),
    )
    per = facts.join(a.select("qid", "content"), "qid").select("qid", "confidence", F.filter("content", lambda w: F.contains(blob, w)).alias("held"))
    base = per.groupBy("qid").agg(F.avg("confidence").alias("mean"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("held"))).alias("held"))
    w = words(F.col("answer"))
    keys = filter_keywords(F.col("question"))
    lower = F.lower("answer")
    marks = question_marks(F.col("question"))
    uncovered = (F.length(lower) - F.length(F.replace(lower, F.lit("not covered"), F.lit("")))) / F.lit(len("not covered"))
    grounded = F.size(F.filter("content", lambda x: F.array_contains("held", x))) / F.size("content")
    penalty = (
        F.when(F.lower(w[0]).isin(*PREPOSITIONS), 0.3).otherwise(0.0)
        + F.when((F.size(w) <= 3) & ~starts_upper_or_digit(w[0]), 0.15).otherwise(0.0)
        + F.when((F.size(keys) > 0) & (overlap(keys, lower) / F.greatest(F.size(keys), F.lit(1)) < 0.2), 0.1).otherwise(0.0)
        + F.when((F.size("content") > 0) & (grounded < 0.3), 0.3).otherwise(0.0)
        + F.when(marks >= 2, uncovered / F.greatest(marks, F.lit(1)) * 0.5).otherwise(0.0)
    )
    start = F.least(F.col("mean") + F.least(F.col("n") * 0.02, F.lit(0.2)), F.lit(1.0))
    blank = F.coalesce(F.trim("answer"), F.lit("")) == ""
    value = F.when(F.col("mean").isNull() | (F.lower(F.trim("answer")) == "unknown"), 0.0).when(blank, start).otherwise(F.greatest(start - penalty, F.lit(0.0)))
    return a.join(base, "qid", "left").select("qid", F.round(value, 6).alias("confidence"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """``qid, answer, labels`` from a model's ``response``: compact JSON, verbose JSON, or its first line."""
    t = strip_fences(F.col("response"))
    v = F.try_parse_json(t)
    is_object = F.startswith(t, F.lit("{")) & v.isNotNull()
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    line = F.element_at(F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 1)
    compact = is_object & get("$.a", "string").isNotNull()
    steps = F.transform(get("$.reasoning_steps", "array<struct<fact_id:string>>"), lambda s: s["fact_id"])
    none = F.array().cast("array<string>")
    answer = F.when(compact, F.trim(get("$.a", "string"))).when(is_object, F.trim(F.coalesce(get("$.answer", "string"), F.lit("")))).otherwise(F.when(t != "", line))
    labels = F.when(compact, F.coalesce(get("$.f", "array<string>"), none)).when(is_object, F.coalesce(steps, none)).otherwise(none)
    return responses.select("qid", answer.alias("answer"), F.filter(labels, lambda x: F.coalesce(x, F.lit("")) != "").alias("labels"))


def tokens_used(lines: DataFrame, questions: DataFrame, prompt_chars: int) -> DataFrame:
    """``qid, tokens``: a quarter of the characters of prompt, question and fact lines, one at least."""
    n = lines.groupBy("qid").agg(F.sum(F.length("line") + 1).alias("chars"))
    total = F.lit(prompt_chars) + F.length("text") + F.coalesce("chars", F.lit(0)) + 8
    return questions.join(n, "qid", "left").select("qid", F.greatest(F.floor(total / 4), F.lit(1)).cast("long").alias("tokens"))
