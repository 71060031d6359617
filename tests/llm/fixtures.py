"""Small frames with the awkward cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and to in river stone amber lantern quiet harbor copper meadow signal thread winter orchard velvet canyon pebble murmur".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + (rng.choice("abcdefgh") + rng.choice("aeiou") if rng.random() < 0.6 else "") for _ in range(n)]
    for i in range(0, n, 12):
        words[i] = "the"
    return " ".join(words)


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def awkward():
    """Nulls in every column, empty and long texts, repeated rows, ties, one doc_id twice."""
    long = prose(99, 30_000)
    return [
        row(1, prose(1, 120)),
        row(2, prose(1, 120)),
        row(2, prose(1, 120)),
        row(3, None),
        row(4, ""),
        row(5, "   \n "),
        row(None, prose(2, 80)),
        row(None, prose(2, 80)),
        row(6, prose(3, 90), None, None),
        row(7, long, "en", "s2"),
        row(8, "x" * 60_000, "en", "s2"),
        row(9, "Ünïcödé ñandú 漢字 🦆 \u0000 end", "de", ""),
        row(9, "another text under one id"),
        (10, "hello", None, None, None),
    ]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def clashing(spark, rows=None):
    """Extra columns with the names that operators use themselves, in odd cases."""
    from pyspark.sql import functions as F

    df = docs(spark, rows)
    names = ["digest", "n", "rank", "Tokens", "n_tokens", "position", "root", "id", "a", "b", "size", "words", "lines", "key", "segments", "unit", "a.b", "__digest", "row", "round_trip", "copies"]
    return df.select("*", *[F.lit(i).alias(x) for i, x in enumerate(names)])
