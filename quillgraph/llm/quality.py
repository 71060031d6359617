"""Quality rules: a threshold table compiled into one projection.

No user functions: every ratio is a built-in expression over the text, its
words and its lines, so the whole stage is a scan, a projection and a filter
with no shuffle.

Cases: a null text, and an empty or blank one, has no words and fails
``few_words``. Repeated rows and ties are judged row by row. An empty table
gives an empty table. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import col, columns, documents, fresh

SYMBOLS = "#$%&*|!@^~<>{}[]=+_\\"

#: The commonest function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is that it for was on are as with be by this at from or an a have not but they which you "
            "der die das und ist von den zu mit ein eine des im für auf nicht sich als dem auch es an werden aus er hat "
            "le la les de du et en un une que qui dans pour est sur au par pas avec ce il sont plus ne "
            "el los las y por con para una se del su al lo no más o como pero sus".split()
        )
    )
)


class Rule(NamedTuple):
    """``metric`` below/above ``threshold`` rejects a text of ``min_words``..``max_words`` words."""

    name: str
    metric: str
    op: str
    threshold: float
    min_words: int = 0
    max_words: int | None = None


#: A type-token ratio falls as texts grow, so its threshold has three length bands.
RULES = (
    Rule("few_words", "n_words", "<", 1),
    Rule("long_words", "mean_word_chars", ">", 40),
    Rule("symbols", "symbol_ratio", ">", 0.04, 5),
    Rule("few_stop_words", "stop_ratio", "<", 0.04, 40),
    Rule("repeated_words", "distinct_word_ratio", "<", 0.35, 20, 1000),
    Rule("repeated_words_long", "distinct_word_ratio", "<", 0.2, 1001, 10000),
    Rule("repeated_words_very_long", "distinct_word_ratio", "<", 0.05, 10001),
    Rule("repeated_lines", "distinct_line_ratio", "<", 0.3, 20),
    Rule("table_lines", "table_line_ratio", ">", 0.5, 10),
)

METRICS = ("n_chars", "n_words", "n_lines", "symbol_chars", "mean_word_chars", "symbol_ratio", "stop_ratio", "distinct_word_ratio", "distinct_line_ratio", "table_line_ratio")


def _metrics(text: Column, words: Column, lines: Column, stop_words: tuple[str, ...]) -> dict[str, Column]:
    n_chars, n_words, n_lines = F.length(text), F.size(words), F.size(lines)
    symbols = n_chars - F.length(F.translate(text, SYMBOLS, ""))
    per = lambda n, d: n / F.greatest(d, F.lit(1))
    return {
        "n_chars": n_chars.cast("long"),
        "n_words": n_words.cast("long"),
        "n_lines": n_lines.cast("long"),
        "symbol_chars": symbols.cast("long"),
        "mean_word_chars": per(n_chars, n_words),
        "symbol_ratio": per(symbols, n_chars),
        "stop_ratio": per(F.size(F.filter(words, lambda w: F.lower(w).isin(*stop_words))), n_words),
        "distinct_word_ratio": per(F.size(F.array_distinct(words)), n_words),
        "distinct_line_ratio": per(F.size(F.array_distinct(lines)), n_lines),
        "table_line_ratio": per(F.size(F.filter(lines, lambda x: F.contains(x, F.lit(" | ")))), n_lines),
    }


def compile_rules(metric, rules=RULES) -> Column:
    """The threshold table as one expression: the names of the rules that a row fails."""
    failed = []
    for r in rules:
        value = metric(r.metric)
        cond = value < F.lit(r.threshold) if r.op == "<" else value > F.lit(r.threshold)
        cond = cond & (metric("n_words") >= r.min_words)
        if r.max_words is not None:
            cond = cond & (metric("n_words") <= r.max_words)
        failed.append(F.when(cond, F.lit(r.name)))
    return F.array_compact(F.array(*failed))


def score(docs: DataFrame, rules=RULES, stop_words=STOP_WORDS, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with a struct of metrics and the failed rules, under names it has not; with those names."""
    text_, words_, lines_, m_, failed_ = fresh(docs, "text", "words", "lines", "metrics", "failed")
    text = F.coalesce(col(text_col), F.lit(""))
    df = docs.select(
        *columns(docs),
        text.alias(text_),
        F.filter(F.split(text, r"\s+"), lambda w: w != "").alias(words_),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias(lines_),
    )
    m = _metrics(col(text_), col(words_), col(lines_), stop_words)
    df = df.select(*columns(docs), F.struct(*[v.alias(k) for k, v in m.items()]).alias(m_))
    return df.withColumn(failed_, compile_rules(lambda k: col(m_)[k], rules)), m_, failed_


def quality_filter(docs: DataFrame, rules=RULES, stop_words=STOP_WORDS, metrics: bool = False) -> DataFrame:
    """The rows that pass every rule, with all their columns (``metrics``: and the metrics beside ``doc_id`` only)."""
    df, m, failed = score(docs, rules, stop_words)
    (row_,) = fresh(docs, "row")
    kept = [col("doc_id"), *[col(m)[k].alias(k) for k in METRICS]] if metrics else columns(docs)
    # A generator in place of a filter: a filter would be pushed below the
    # projection and the words split once for the filter, once for the output.
    one = F.when(F.size(col(failed)) == 0, F.array(F.struct(*kept))).otherwise(F.slice(F.array(F.struct(*kept)), 1, 0))
    return df.select(F.explode(one).alias(row_)).select(f"{row_}.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(documents(spark, sf_dir), metrics=True)


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    conds = []
    for r in RULES:
        c = f"{r.metric} {r.op} {r.threshold} AND n_words >= {r.min_words}"
        conds.append(f"({c}" + (f" AND n_words <= {r.max_words})" if r.max_words is not None else ")"))
    return f"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls
  FROM documents),
counts AS (
  SELECT doc_id, length(t) AS n_chars, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ls) AS BIGINT) AS n_lines,
         length(t) - length(translate(t, '{SYMBOLS}', '')) AS symbol_chars,
         len(list_filter(ws, lambda w: list_contains([{stops}], lower(w)))) AS stop_n,
         len(list_distinct(ws)) AS distinct_n, len(list_distinct(ls)) AS distinct_l,
         len(list_filter(ls, lambda x: contains(x, ' | '))) AS table_l
  FROM parts),
metrics AS (
  SELECT doc_id, n_chars, n_words, n_lines, symbol_chars,
         n_chars::DOUBLE / greatest(n_words, 1) AS mean_word_chars,
         symbol_chars::DOUBLE / greatest(n_chars, 1) AS symbol_ratio,
         stop_n::DOUBLE / greatest(n_words, 1) AS stop_ratio,
         distinct_n::DOUBLE / greatest(n_words, 1) AS distinct_word_ratio,
         distinct_l::DOUBLE / greatest(n_lines, 1) AS distinct_line_ratio,
         table_l::DOUBLE / greatest(n_lines, 1) AS table_line_ratio
  FROM counts)
SELECT * FROM metrics WHERE NOT ({" OR ".join(conds)})"""


ORACLE_SQL = _oracle()
