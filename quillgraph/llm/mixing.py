"""Mixing sources to target weights along a time-varying curriculum.

A schedule gives each source a weight at a few knots of the training time
t in [0, 1], linear between them; the weights at a knot are scaled to sum to 1
(so they do everywhere). With a budget of T tokens source s is due
``D_s(t) = T * integral_0^t w_s`` tokens by time t. The documents of a source
stand in a seeded random order; one whose predecessors hold c tokens gets the
position ``t`` at which ``D_s(t) = c``, the root of a quadratic on its segment
of the schedule. Documents beyond ``D_s(1)`` are left out, and the rest is
range-sorted by position.

T is the largest budget for which no source runs dry, so the scarcest source
bounds all others; with ``keep_all`` it is the smallest that has room for every
source, and scarce sources run dry on the way, each where its documents end. Token counts are
``ceil(bytes / 4)``, integers, so that prefix sums do not depend on their order
of summation. They are taken in two levels: totals of 4,096 hash ranges per source,
then within a range, so that no task holds a whole source, however hot.

The default schedule starts from the natural shares of the sources and ends
at shares raised to the power 0.7, which lifts small sources late in training.

Cases: a null source is a source of its own. Null and empty texts hold no
tokens and share the position of what follows them. Rows that tie in the
random order (same ``doc_id``) are ordered by a hash of all columns; repeated
rows each take their turn. A source that the schedule does not name, or names
with no weight, is left out. An empty table gives an empty table; extra
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import col, columns, documents, fresh

SEED = "mix-1"
#: (time, power of the natural share) at the knots of the default schedule.
TEMPERATURES = ((0.0, 1.0), (0.5, 0.9), (1.0, 0.7))
#: Hex digits of the order hash that name a range: 16 ** 3 ranges per source.
RANGE_DIGITS = 3


def source_key(source: Column) -> Column:
    """Null as a key of its own, which no string equals."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def temperature_schedule(supply: DataFrame, temperatures=TEMPERATURES) -> DataFrame:
    """``key, t, weight`` from ``key, tokens``: natural shares to the given power at each knot, scaled to sum to 1."""
    knots = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(p)).alias("p")) for t, p in temperatures])).alias("k")
    share = supply.select("key", "tokens", knots).where(F.col("tokens") > 0)
    return share.select("key", F.col("k.t").alias("t"), F.pow(F.col("tokens").cast("double"), F.col("k.p")).alias("weight"))


def fixed_schedule(spark: SparkSession, knots: list[tuple[str | None, float, float]]) -> DataFrame:
    """``key, t, weight`` from (source, time, weight); all sources must share their knots, 0 and 1 among them."""
    times: dict[str | None, list[float]] = {}
    for source, t, w in knots:
        if w < 0:
            raise ValueError("weights are not negative")
        times.setdefault(source, []).append(float(t))
    grids = {tuple(sorted(x)) for x in times.values()}
    if len(grids) != 1 or min(grid := next(iter(grids))) != 0.0 or max(grid) != 1.0 or len(set(grid)) != len(grid):
        raise ValueError("all sources need the same knots, from 0 to 1, each once")
    rows = [("0" if s is None else f"1{s}", float(t), float(w)) for s, t, w in knots]
    return spark.createDataFrame(rows, "key string, t double, weight double")


def demand_segments(schedule: DataFrame, supply: DataFrame, keep_all: bool = False) -> DataFrame:
    """The scaled schedule by segment: ``key, t0, h, a, b, c0, c1`` with cumulative demand c in tokens.

    A few rows per source; sums over sources are rounded so that they don't depend on order.
    """
    total = Window.partitionBy("t")
    along = Window.partitionBy("key").orderBy("t")
    s = schedule.withColumn("w", F.col("weight") / F.round(F.sum("weight").over(total), 6))
    s = s.select("key", F.col("t").alias("t0"), (F.lead("t").over(along) - F.col("t")).alias("h"), F.col("w").alias("a"), F.lead("w").over(along).alias("b")).where(F.col("h").isNotNull())
    s = s.withColumn("area", (F.col("a") + F.col("b")) / 2 * F.col("h"))
    s = s.withColumn("d1", F.sum("area").over(Window.partitionBy("key").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)))
    whole = s.groupBy("key").agg(F.sum("area").alias("whole")).where(F.col("whole") > 0)
    # A source that the schedule names and the corpus lacks bounds nothing.
    budget = whole.join(supply, "key").agg((F.max if keep_all else F.min)(F.col("tokens") / F.col("whole")).alias("budget"))
    return s.crossJoin(budget).select("key", "t0", "h", "a", "b", ((F.col("d1") - F.col("area")) * F.col("budget")).alias("c0"), (F.col("d1") * F.col("budget")).alias("c1"), "budget")


def mix(docs: DataFrame, schedule: DataFrame | None = None, temperatures=TEMPERATURES, seed: str = SEED, position: str | None = None, tokens: str | None = None, keep_all: bool = False) -> DataFrame:
    """The documents in training order; ``position`` and ``tokens`` name columns for these."""
    key_, tok_, hash_, range_, tie_, run_, before_, segs_, upto_, pos_ = fresh(docs, "key", "tok", "hash", "range", "tie", "run", "before", "segs", "upto", "pos")
    hashable = [col(f.name) for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    order = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(col("doc_id").cast("string"), F.lit(""))))
    df = docs.withColumns({
        key_: source_key(col("source")),
        tok_: F.ceil(F.coalesce(F.octet_length(col("text")), F.lit(0)) / 4).cast("long"),
        hash_: order,
        tie_: F.xxhash64(*hashable),
    }).withColumn(range_, F.substring(hash_, 1, RANGE_DIGITS))

    totals = df.select(col(key_).alias("key"), col(range_).alias("range"), col(tok_).alias("tok")).groupBy("key", "range").agg(F.sum("tok").alias("tok"))
    supply = totals.groupBy("key").agg(F.sum("tok").alias("tokens"))
    segments = demand_segments(schedule if schedule is not None else temperature_schedule(supply, temperatures), supply, keep_all)
    per_source = segments.where(F.col("c1") > F.col("c0")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c0", "c1", "t0", "h", "a", "b", "budget"))).alias("segs"))
    # Where a range begins and what its source is due: a row for each range of each source,
    # so that the documents themselves are joined once, by range, and never by source.
    starts = totals.withColumn("before", F.sum("tok").over(Window.partitionBy("key").orderBy("range")) - F.col("tok")).join(per_source, "key")
    starts = starts.select(col("key").alias(key_), col("range").alias(range_), col("before").alias(before_), F.col("segs").alias(segs_))

    within = Window.partitionBy(key_, range_).orderBy(hash_, col("doc_id").asc_nulls_last(), tie_).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(starts, [key_, range_]).withColumn(run_, col(before_) + F.sum(tok_).over(within) - col(tok_))
    at = F.filter(col(segs_), lambda x: (x["c0"] <= col(run_)) & (col(run_) < x["c1"]))
    hit = df.withColumn(upto_, F.try_element_at(at, F.lit(1))).where(col(upto_).isNotNull())
    s = lambda f: col(upto_)[f]
    q = (col(run_) - s("c0")) / s("budget")
    root = F.sqrt(F.greatest(s("a") * s("a") + 2 * (s("b") - s("a")) * q / s("h"), F.lit(0.0)))
    hit = hit.withColumn(pos_, F.round(s("t0") + F.coalesce(F.try_divide(2 * q, s("a") + root), F.lit(0.0)), 9))
    out = hit.orderBy(pos_, hash_, col("doc_id").asc_nulls_last(), tie_)
    return out.select(*columns(docs), *([col(tok_).alias(tokens)] if tokens else []), *([col(pos_).alias(position)] if position else []))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training positions of all documents that the schedule has room for, in their order."""
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text"), position="position", tokens="tokens").select("doc_id", "source", "tokens", "position")


_KNOTS = ", ".join(f"({float(t)}::DOUBLE, {float(p)}::DOUBLE)" for t, p in TEMPERATURES)
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key,
         CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT) AS tokens, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY key ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS run FROM d),
supply AS (SELECT key, sum(tokens) AS tokens FROM d GROUP BY key),
knots(t, p) AS (VALUES {_KNOTS}),
w AS (SELECT key, t, pow(CAST(tokens AS DOUBLE), p) AS weight FROM supply, knots WHERE tokens > 0),
n AS (SELECT key, t, weight / round(sum(weight) OVER (PARTITION BY t), 6) AS w FROM w),
g AS (SELECT key, t AS t0, lead(t) OVER k - t AS h, w AS a, lead(w) OVER k AS b FROM n WINDOW k AS (PARTITION BY key ORDER BY t)),
s AS (SELECT *, (a + b) / 2 * h AS area FROM g WHERE h IS NOT NULL),
c AS (SELECT *, sum(area) OVER (PARTITION BY key ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS d1 FROM s),
budget AS (SELECT min(tokens / whole) AS budget FROM (SELECT key, sum(area) AS whole FROM s GROUP BY key) JOIN supply USING (key)),
e AS (SELECT key, t0, h AS hh, a, b, (d1 - area) * budget AS c0, d1 * budget AS c1, budget FROM c, budget),
x AS (SELECT doc_id, source, tokens, t0, hh, a, b, (run - c0) / budget AS q FROM r JOIN e ON r.key = e.key AND run >= c0 AND run < c1 AND c1 > c0)
SELECT doc_id, source, tokens,
       round(t0 + coalesce(2 * q / nullif(a + sqrt(greatest(a * a + 2 * (b - a) * q / hh, 0)), 0), 0), 9) AS position
FROM x"""
