"""Connected components by written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import discard, materialise


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest id of each connected component: ``(node, root)`` for every node of ``edges``.

    ``edges`` has the columns ``a`` and ``b``. Alternates large-star and
    small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) until nothing moves: O(log^2 n) rounds, each two
    shuffles of the edges. Every round is a written table, so that a lost
    executor costs one round at most; the round before is deleted then. Null
    ends and self-loops are ignored.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(low, "u")
        if small:
            moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.where(F.col("a") != F.col("b")).distinct()

    e = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        e, old = materialise(star(star(e, small=False), small=True), name), e
        discard(old)
        # The sum of hashes pins the edge set; two equal rounds mean a fixed point.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
