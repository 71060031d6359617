"""The graph of facts: neighbourhoods, paths, hop counts, pruning and statistics, as joins on edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import materialise

EDGE_COLUMNS = ["src", "dst", "fact_id", "predicate", "confidence", "source_doc"]


def edges(facts: DataFrame) -> DataFrame:
    """Facts between two entities; literal facts are no edges."""
    return facts.where(F.col("subject_id").isNotNull() & F.col("object_id").isNotNull()).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("id").alias("fact_id"), "predicate", "confidence", "source_doc")


def both_ways(e: DataFrame) -> DataFrame:
    pair = e.select("src", "dst")
    return pair.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(links: DataFrame, seeds: DataFrame, hops: int, key: list[str] | None = None) -> DataFrame:
    """``[key], node, depth``: nodes within ``hops`` of the seeds along ``links`` (src, dst), by least depth.

    ``seeds`` has ``node`` and the columns of ``key``, each key being a search
    of its own. A level is one join and one anti-join against what was seen;
    levels are written tables, so neither lineage nor a lost executor adds up.
    """
    key = key or []
    seen = seeds.select(*key, "node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, hops + 1):
        found = frontier.select(*key, F.col("node").alias("src")).join(links.select("src", "dst"), "src").select(*key, F.col("dst").alias("node")).distinct()
        frontier = found.join(seen.select(*key, "node"), [*key, "node"], "left_anti").withColumn("depth", F.lit(depth))
        if depth < hops:
            frontier = materialise(frontier, "bfs")
        seen = seen.union(frontier)
    return seen


def subgraph(e: DataFrame, seeds: DataFrame, hops: int = 2, max_nodes: int | None = None, mode: str = "bfs") -> tuple[DataFrame, DataFrame]:
    """Nodes (``node, depth``) within ``hops`` undirected steps and the edges that a step expanded.

    ``mode="bfs"``: all seeds at once; ``max_nodes`` is exact, nearest first and
    then by id. ``mode="seeded"``: the seeds in order of ``seq``, each expanding
    all nodes gathered before it as well, and ``max_nodes`` checked after each
    ring, so that the last ring is kept whole.
    """
    links = both_ways(e)
    if mode == "bfs":
        nodes = bfs(links, seeds, hops)
        if max_nodes is not None:
            nodes = nodes.orderBy("depth", "node").limit(max_nodes)
        inner = nodes.where(F.col("depth") < hops).select("node")
        n = nodes.select("node")
        ends = e.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
        touched = ends.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(ends.join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        return nodes, touched.distinct().select(*EDGE_COLUMNS)
    if mode != "seeded":
        raise ValueError(f"unknown mode {mode!r}")
    spark = e.sparkSession
    nodes = spark.createDataFrame([], "node string, depth int")
    expanded = spark.createDataFrame([], "node string")
    for r in seeds.orderBy("seq").select("node").collect():
        nodes = nodes.union(spark.createDataFrame([(r["node"], 0)], "node string, depth int")).groupBy("node").agg(F.min("depth").alias("depth"))
        for ring in range(1, hops + 1):
            expanded = expanded.union(nodes.select("node")).distinct()
            new = nodes.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node"), F.lit(ring).alias("depth"))
            nodes = materialise(nodes.union(new).groupBy("node").agg(F.min("depth").alias("depth")), "ring")
            if max_nodes is not None and nodes.count() >= max_nodes:
                break
    x = expanded.withColumnRenamed("node", "src")
    touched = e.join(x, "src", "left_semi").select(*EDGE_COLUMNS).union(e.join(x.withColumnRenamed("src", "dst"), "dst", "left_semi").select(*EDGE_COLUMNS)).distinct()
    return nodes, touched


def neighbours(e: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """``seed, neighbour, predicate, fact_id``: targets of the out-edges of nodes at depth - 1 or less."""
    around = bfs(e.select("src", "dst"), seeds.select(F.col("node").alias("seed"), "node"), depth - 1, ["seed"]) if depth > 1 else seeds.select(F.col("node").alias("seed"), "node")
    return around.select("seed", F.col("node").alias("src")).join(e, "src").select("seed", F.col("dst").alias("neighbour"), "predicate", "fact_id").distinct()


def reasoning_paths(e: DataFrame, entities: DataFrame) -> DataFrame:
    """``fact_id, path``: each edge as ``name [predicate] name``."""
    s = entities.select(F.col("id").alias("src"), F.col("name").alias("s"))
    d = entities.select(F.col("id").alias("dst"), F.col("name").alias("d"))
    named = e.join(s, "src", "left").join(d, "dst", "left")
    text = F.concat(F.coalesce("s", "src"), F.lit(" ["), F.coalesce("predicate", F.lit("related to")), F.lit("] "), F.coalesce("d", "dst"))
    return named.select("fact_id", text.alias("path"))


def hop_chains(e: DataFrame, pairs: DataFrame, max_hops: int = 3) -> DataFrame:
    """``a, b, path`` of a shortest directed path of ``max_hops`` at most; of several the least by ids.

    One path for each (a, node) is kept at a level, the least one, so a level
    is never larger than what is reachable.
    """
    links = e.select("src", "dst").distinct()
    starts = pairs.select("a").distinct()
    level = starts.select("a", F.col("a").alias("node"), F.array("a").alias("path"))
    seen = level
    for hop in range(max_hops):
        steps = level.join(links, level["node"] == links["src"]).select("a", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        least = steps.groupBy("a", "node").agg(F.min("path").alias("path"))
        level = least.join(seen.select("a", "node"), ["a", "node"], "left_anti")
        if hop < max_hops - 1:
            level = materialise(level, "chain")
        seen = seen.unionByName(level)
    return pairs.join(seen.withColumnRenamed("node", "b"), ["a", "b"]).select("a", "b", "path")


def hop_counts(e: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """``seed, node, hops`` along directed edges."""
    found = bfs(e.select("src", "dst").distinct(), seeds.select(F.col("node").alias("seed"), "node"), max_hops, ["seed"])
    return found.select("seed", "node", F.col("depth").alias("hops"))


def prune(e: DataFrame, min_confidence: float) -> DataFrame:
    """Edges at or above a confidence, where none counts as 1; nodes are not dropped with them."""
    return e.where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)


def graph_stats(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """``nodes, edges, avg_degree``; one row."""
    n = nodes.agg(F.count("*").alias("nodes"))
    m = e.agg(F.count("*").alias("edges"))
    return n.crossJoin(m).select("nodes", "edges", (F.col("edges") * 2.0 / F.greatest("nodes", F.lit(1))).alias("avg_degree"))


def least(order: list[Column], by: list[str], df: DataFrame, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")
