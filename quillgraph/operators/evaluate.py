"""Deterministic scores of answers against what was expected of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import words


def found_share(expected: Column, haystack: Column) -> Column:
    """The share of expected texts that are found, whatever their case; 1 where none is expected."""
    hits = F.size(F.filter(expected, lambda x: F.contains(F.lower(haystack), F.lower(x))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.greatest(F.size(expected), F.lit(1)))


def is_correct(expected: Column, answer: Column) -> Column:
    return F.exists(expected, lambda x: F.contains(F.lower(answer), F.lower(x)))


def exact_match(answer: Column, gold: Column) -> Column:
    return F.lower(F.trim(answer)) == F.lower(F.trim(gold))


def token_f1(answer: Column, gold: Column) -> Column:
    """F1 of the sets of words; 0 where one is empty or nothing is shared."""
    a, g = (F.array_distinct(words(F.lower(x))) for x in (answer, gold))
    both = F.size(F.array_intersect(a, g))
    p, r = both / F.greatest(F.size(a), F.lit(1)), both / F.greatest(F.size(g), F.lit(1))
    return F.when(both == 0, 0.0).otherwise(2 * p * r / (p + r))


def case_scores(cases: DataFrame) -> DataFrame:
    """``match`` and ``recall`` of ``answer, expected, evidence, expected_entities``."""
    return cases.withColumn("match", found_share(F.col("expected"), F.col("answer"))).withColumn("recall", found_share(F.col("expected_entities"), F.col("evidence")))


def report(cases: DataFrame) -> DataFrame:
    s = case_scores(cases)
    mean = lambda c: F.round(F.avg(c), 6)
    return s.agg(F.count("*").alias("n"), mean((F.col("match") >= 0.5).cast("int")).alias("pass_rate"), mean("match").alias("mean_match"), mean("recall").alias("mean_recall"), mean("tokens_used").alias("mean_tokens"), mean("latency_ms").alias("mean_latency_ms"))
