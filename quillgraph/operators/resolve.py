"""Entity resolution: mentions to entities by exact name, alias, fuzzy match, or as new entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.text import token_sort, words
from quillgraph.operators.components import connected_components

FUZZY_THRESHOLD = 85.0


def entity_id(name: Column) -> Column:
    """Follows from the name, so that a retried task gives the same."""
    return F.concat(F.lit("e:"), F.substring(F.sha2(name, 256), 1, 16))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the longer list of words, in percent."""
    x, y = words(F.lower(a)), words(F.lower(b))
    return F.size(F.array_intersect(x, y)) * 100.0 / F.greatest(F.size(x), F.size(y), F.lit(1))


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (len(a) + len(b)): the similarity under insertions and deletions, in percent.

    Bit-parallel longest common subsequence (Hyyro 2004): one word of len(a) bits per step.
    """
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


# Otherwise a filter on it moves below the distinct pairs, and each pair is compared once for each shared bigram.
indel_similarity = indel_similarity.asNondeterministic()


def candidate_names(entities: DataFrame) -> DataFrame:
    """``entity_id, name, candidate`` with the entity's name and each alias as candidate."""
    return entities.select(F.col("id").alias("entity_id"), "name", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("candidate"))


def bigram_block(df: DataFrame, name: str, out: str) -> DataFrame:
    """``df`` with the sorted words of ``name`` as ``out``, a row for each ``gram``."""
    s = token_sort(F.lower(F.col(name)))
    grams = F.when(F.length(s) < 3, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))))
    return df.select("*", s.alias(out), F.explode(F.concat(grams, F.when(F.length(s) < 5, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))).alias("gram"))


def fuzzy_pairs(mentions: DataFrame, entities: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """``mention, entity_id, score`` of candidates at or over the threshold.

    Blocked on shared character bigrams of the sorted words: at a similarity of
    t percent two strings share so long a subsequence that they share a bigram
    (for t over 67, unless both are shorter than three characters, which are
    their own block). Lengths bound the similarity before Python sees a pair.
    Forms (names with sorted words) are compared, each once, however many
    mentions and entities have it.
    """
    with_form = lambda df, c, out: df.select(c).distinct().withColumn(out, token_sort(F.lower(F.col(c))))
    grams = lambda df, c: bigram_block(df.select(c).distinct(), c, "form").select(c, "gram")
    named = candidate_names(entities).select("entity_id", "candidate")
    m, e = with_form(mentions, "mention", "sorted_m"), with_form(named, "candidate", "sorted_e")
    la, lb = F.length("sorted_m"), F.length("sorted_e")
    pairs = grams(m, "sorted_m").join(grams(e, "sorted_e"), "gram").where(F.least(la, lb) * 200.0 >= threshold * (la + lb)).select("sorted_m", "sorted_e").distinct()
    close = pairs.withColumn("score", indel_similarity("sorted_m", "sorted_e")).where(F.col("score") >= threshold)
    scored = m.join(close, "sorted_m").join(e, "sorted_e").select("mention", "candidate", "score")
    return scored.join(named, "candidate").groupBy("mention", "entity_id").agg(F.max("score").alias("score"))


def resolve(mentions: DataFrame, entities: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """``mention, entity_id, how`` for each distinct mention; ``how`` is exact, alias, fuzzy or new.

    Blank mentions are one entity, "unknown". Mentions are resolved against the
    entities as they stand, not against each other's creations.
    """
    m = mentions.select(F.when(F.trim("mention") == "", "unknown").otherwise(F.trim("mention")).alias("mention")).where(F.col("mention").isNotNull()).distinct()
    # Of entities that share a name only the first can win: one row for each name before anything is joined.
    as_name = entities.select(F.lit(1).alias("kind"), F.col("name").alias("name"), F.col("id").alias("entity_id"))
    as_alias = candidate_names(entities).select(F.lit(2).alias("kind"), F.lower("candidate").alias("name"), "entity_id")
    known = as_name.union(as_alias).where("name IS NOT NULL").groupBy("kind", "name").agg(F.min("entity_id").alias("entity_id"))
    step = lambda rank, kind, name: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), name.alias("name"))
    steps = m.select("mention", F.inline(F.array(step(1, 1, F.col("mention")), step(2, 1, F.lower("mention")), step(3, 2, F.lower("mention")))))
    hit = F.when(F.col("entity_id").isNotNull(), F.struct("rank", "entity_id"))
    best = steps.join(known, ["kind", "name"], "left").groupBy("mention").agg(F.min(hit).alias("best")).select("mention", "best.rank", "best.entity_id")
    # No similarity is over 100.
    if threshold <= 100:
        near = fuzzy_pairs(best.where("rank IS NULL"), entities, threshold).groupBy("mention").agg(F.min(F.struct(-F.col("score"), "entity_id")).alias("near"))
        best = best.join(near, "mention", "left").select("mention", F.coalesce("rank", F.when(F.col("near").isNotNull(), 4)).alias("rank"), F.coalesce("entity_id", "near.entity_id").alias("entity_id"))
    how = F.when(F.col("rank") <= 2, "exact").when(F.col("rank") == 3, "alias").when(F.col("rank") == 4, "fuzzy").otherwise("new")
    return best.select("mention", F.coalesce("entity_id", entity_id(F.col("mention"))).alias("entity_id"), how.alias("how"))


def name_groups(names: DataFrame, threshold: float) -> DataFrame:
    """``node, root`` by hash of sorted words: names that matches at or over the threshold connect, however far."""
    # A distinct name has one form; the slack is that of the scan.
    forms = bigram_block(names.select("mention").distinct(), "mention", "form").select("form", "gram").distinct()
    a, b = forms.withColumnRenamed("form", "x"), forms.withColumnRenamed("form", "y")
    near = F.least(F.length("x"), F.length("y")) * 200.0 >= threshold * (F.length("x") + F.length("y"))
    pairs = a.join(b, "gram").where((F.col("x") < F.col("y")) & near).select("x", "y").distinct()
    close = pairs.where(indel_similarity("x", "y") > threshold - 1e-9)
    return connected_components(close.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b")), "names")


def resolve_online(mentions: DataFrame, entities: DataFrame, threshold: float = FUZZY_THRESHOLD, block: Column | None = None) -> DataFrame:
    """Greedy resolution in order of ``seq``: a mention sees what all earlier mentions created.

    Only names that are connected through pairs at or over the threshold can
    reach each other, so each such group (candidates as in ``fuzzy_pairs``) is
    scanned on its own with the result of a scan of everything. ``block``
    restricts the scan to mentions of one block instead; a group or block must
    fit a worker.
    """
    known = candidate_names(entities).select(F.lit(-1).cast("long").alias("seq"), F.col("candidate").alias("mention"), "entity_id")
    rows = mentions.select(F.col("seq").cast("long").alias("seq"), "mention", F.lit(None).cast("string").alias("entity_id")).unionByName(known)
    if block is not None:
        rows = rows.withColumn("block", block)
    else:
        rows = rows.withColumn("node", F.xxhash64(token_sort(F.lower("mention"))))
        rows = rows.join(name_groups(rows, threshold), "node", "left").withColumn("block", F.coalesce("root", "node")).drop("node", "root")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        exact: dict[str, str] = {}
        names: list[tuple[str, str]] = []
        out = []
        for seq, mention, known_id in pdf.sort_values(["seq", "mention", "entity_id"])[["seq", "mention", "entity_id"]].itertuples(index=False):
            sorted_ = " ".join(sorted(mention.lower().split()))
            if seq < 0:
                exact.setdefault(mention.lower(), known_id)
                names.append((sorted_, known_id))
                continue
            found, how = exact.get(mention.lower()), "exact"
            if found is None:
                score, how = threshold - 1e-9, "fuzzy"
                for other, eid in names:
                    if min(len(other), len(sorted_)) * 200 >= threshold * (len(other) + len(sorted_)) and (s := indel_ratio(sorted_, other)) > score:
                        found, score = eid, s
            if found is None:
                found, how = "e:" + hashlib.sha256(mention.encode()).hexdigest()[:16], "new"
            exact.setdefault(mention.lower(), found)
            names.append((sorted_, found))
            out.append((seq, mention, found, how))
        return pd.DataFrame(out, columns=["seq", "mention", "entity_id", "how"])

    return rows.groupBy("block").applyInPandas(run, "seq long, mention string, entity_id string, how string")


def add_aliases(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entities with the mentions that reached them by fuzzy match among their aliases."""
    new = resolved.where(F.col("how") == "fuzzy").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("mention")).alias("__new"))
    none = F.array().cast("array<string>")
    return entities.join(new, "id", "left").withColumn("aliases", F.array_union(F.coalesce("aliases", none), F.coalesce("__new", none))).select(*entities.columns)


def merge(entities: DataFrame, facts: DataFrame, pairs: DataFrame, repoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """Merge ``drop_id`` into ``keep_id``: names and aliases are united, facts repointed, dropped rows removed."""
    p = pairs.select("keep_id", "drop_id")
    gone = p.join(entities, F.col("id") == F.col("drop_id")).groupBy("keep_id").agg(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("__a"), F.min("entity_type").alias("__t"))
    none = F.array().cast("array<string>")
    merged = entities.join(p.select(F.col("drop_id").alias("id")), "id", "left_anti").join(gone.withColumnRenamed("keep_id", "id"), "id", "left")
    merged = merged.withColumn("aliases", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("__a", none)))).withColumn("entity_type", F.coalesce("entity_type", "__t")).select(*entities.columns)
    if repoint:
        to = lambda c: p.select(F.col("drop_id").alias(c), F.col("keep_id").alias(f"__{c}"))
        facts = facts.join(to("subject_id"), "subject_id", "left").join(to("object_id"), "object_id", "left").withColumn("subject_id", F.coalesce("__subject_id", "subject_id")).withColumn("object_id", F.coalesce("__object_id", "object_id")).select(*facts.columns)
    return merged, facts


def search(entities: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """Entities whose name or an alias contains a text, whatever its case; the first by name and id."""
    q = needle.lower()
    hit = F.contains(F.lower("name"), F.lit(q)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q)))
    return entities.where(hit).orderBy("name", "id").limit(limit)
