"""SimHash near-dedup by multi-index hashing.

A text is lower-cased and cut into words; its features are the hashes of its
distinct words and of its distinct pairs of neighbouring words (of its only
word, if it has one). Its fingerprint follows from the text alone, so what
becomes of two texts never depends on the rest of the table. It has two parts:

* a *signature* of 512 bits for the complete distance: a plain SimHash of the
  pairs and one of the words, 256 bits each, in which all features weigh the
  same. Unrelated texts differ in about 256 bits. Edits spread over a text
  change twice as many pairs as words, a passage in common covers both alike,
  so that words and pairs together tell a near copy (a tenth of the words
  changed: about 75) from two texts around the same boilerplate (half of either:
  about 137);
* ``SEGMENTS`` index segments of 33 bits. A plain SimHash segment of this width
  flips 5 bits at such edits, and the Hamming ball that would find it has
  285,340 members. So a segment is drawn from samples: each of its three parts
  is the SimHash of the ``SAMPLE`` pairs that rank lowest under a seed of
  its own, with the weights ``u ** -POWER`` of their ranks' values ``u``. When
  an edit spares the first of a sample it flips one bit at most. Three parts,
  because texts that share no more than a passage have one part decided by it
  now and then, but hardly ever all three: where a share s of the pairs is
  common, the chance goes with the cube of s.

Around each segment the Hamming ball of radius 1 is enumerated, the table of
segments is joined on (segment, value), and each pair so found is verified by
its complete distance, ``MAX_DISTANCE`` at most. Of two values that differ in a
bit, the one that has it set asks for the other, so that a ball costs 17
lookups on average instead of 34. Verified pairs are closed to groups by
connected components; of each group the smallest ``doc_id`` stays.

The segments are not slices of the signature, so the guarantee of slices (one of
m is within d / m) does not hold; README gives the share of pairs found at
each distance.

No cap on partners. Equal fingerprints (copies) are folded into one
representative before the index. Near copies are joined to the first of their
bucket if they are within the distance of it, and only pairs that this leaves
in different groups are taken from the index: a group of k texts costs about k
comparisons, not k squared, and comes out the same.

Cases: texts without a word (null, empty, blank, only marks) have no
fingerprint and stay. Very long texts are read whole. Rows without a ``doc_id``
stay. Rows that share a ``doc_id`` go or stay together, and of rows with equal
``doc_id`` and text one stays. ``doc_id`` is an integer (a string that is none
is an error). An empty table gives an empty table; extra columns are carried
along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import col, columns, connected_components, documents, fresh
from quillgraph.session import discard, materialise

SEGMENTS = 16
PARTS = 3
PART_BITS = 11
SEGMENT_BITS = PARTS * PART_BITS
POWER = 2.5
#: Pairs in the sample that a part of a segment is drawn from.
SAMPLE = 8
WORDS_64 = 8
MAX_DISTANCE = 100
#: Word hashes that a worker remembers; a matter of speed alone.
REMEMBERED = 1 << 19

SIGNATURE = [f"s{i}" for i in range(WORDS_64)]

_WORD = re.compile(r"\w+")
_U = np.uint64
_BITS = np.arange(PART_BITS, dtype=np.uint64)
_SIGN_SEEDS = (np.arange(11, 11 + WORDS_64, dtype=np.uint64) * _U(0xA0761D6478BD642F))[:, None]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit words that looks random."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = mix(np.arange(1, PARTS * SEGMENTS + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))[:, None]


class WordHashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def features(text: str, seen: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the pairs of neighbouring words, and of the words."""
    found = _WORD.findall(text.lower())
    words = np.fromiter(map(seen.__getitem__, found), dtype=np.uint64, count=len(found))
    pairs = words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:] if len(words) > 1 else words
    return np.unique(pairs), np.unique(words)


def segments_of(f: np.ndarray) -> np.ndarray:
    """The index segments of the pairs of a text."""
    z = (f[None, :] ^ _SEEDS) * _U(0x9E3779B97F4A7C15)
    z ^= z >> _U(32)
    z *= _U(0xD6E8FEB86659FD93)
    if SAMPLE < z.shape[1]:
        z.partition(SAMPLE - 1, axis=1)
        z = z[:, :SAMPLE]
    # Summed in a fixed order, so that equal features give equal bits.
    z.sort(axis=1)
    weights = ((z.astype(np.float64) + 1) / 2.0**64) ** -POWER
    signs = ((mix(z)[:, :, None] >> _BITS) & _U(1)).astype(np.float64) * 2 - 1
    on = (signs * weights[:, :, None]).sum(1) > 0
    parts = (on.astype(np.int64) << np.arange(PART_BITS)).sum(1).reshape(SEGMENTS, PARTS)
    return (parts << (PART_BITS * np.arange(PARTS))).sum(1)


def simhash(f: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A plain SimHash of 64 bits for each seed, in bytes."""
    ones = np.zeros(64 * len(seeds), dtype=np.int64)
    for at in range(0, len(f), 8192):
        s = mix(f[None, at : at + 8192] + seeds)
        ones += np.unpackbits(s.T.copy().view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(ones * 2 > len(f))


def fingerprint(text: str, seen: WordHashes) -> tuple[np.ndarray, np.ndarray] | None:
    """The index segments and the signature (8 words of 64 bits) of a text; none if it has no word."""
    pairs, words = features(text, seen)
    if not len(words):
        return None
    half = WORDS_64 // 2
    return segments_of(pairs), np.concatenate([simhash(pairs, _SIGN_SEEDS[:half]), simhash(words, _SIGN_SEEDS[half:])]).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = WordHashes()
    for batch in batches:
        ids, segments, signatures = [], [], []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            if (f := fingerprint(text.as_py(), seen)) is not None:
                ids.append(doc_id.as_py())
                segments.append(f[0])
                signatures.append(f[1])
        if ids:
            s = pa.array(np.concatenate(segments), pa.int64())
            g = np.stack(signatures)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(np.arange(0, len(s) + 1, SEGMENTS, dtype=np.int32), s), *[pa.array(np.ascontiguousarray(g[:, i])) for i in range(WORDS_64)]],
                ["doc_id", "segments", *SIGNATURE],
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, segments, s0..s7`` of every row with a ``doc_id`` and a word."""
    schema = "doc_id long, segments array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE)
    rows = docs.where(col("doc_id").isNotNull() & col("text").isNotNull()).select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"))
    return rows.mapInArrow(_fingerprints, schema)


def segment_keys(folded: DataFrame) -> DataFrame:
    """``id, key`` and what else ``folded`` has but signatures; a segment's number sits above its bits."""
    rest = [c for c in folded.columns if c not in ("id", "segments", *SIGNATURE)]
    seg = folded.select("id", *rest, F.posexplode("segments").alias("seg", "value"))
    return seg.select("id", *rest, (F.shiftleft(F.col("seg").cast("long"), SEGMENT_BITS) + F.col("value")).alias("key"))


def verified(found: DataFrame, folded: DataFrame, max_distance: int) -> DataFrame:
    """Pairs ``a, b`` whose complete distance is ``max_distance`` at most, with it."""
    of = lambda end: folded.select(F.col("id").alias(end), *[F.col(s).alias(f"{end}_{s}") for s in SIGNATURE])
    distance = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SIGNATURE), F.lit(0))
    return found.join(of("a"), "a").join(of("b"), "b").where(distance <= max_distance).select("a", "b", distance.alias("distance"))


def near_pairs(folded: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs ``a < b`` of ``id`` within ``max_distance``, found through the segment index of ``id, segments, s0..``.

    With a column ``root`` only pairs whose roots differ are looked for.
    """
    rooted = "root" in folded.columns
    # As a difference a root is mostly 0, which shuffles to next to nothing.
    step = [(F.col("id") - F.col("root")).alias("step")] if rooted else []
    segment = segment_keys(folded.select("id", "segments", *step))
    table = segment.select("key", F.col("id").alias("b"), *(["step"] if rooted else []))
    if rooted:
        table = table.withColumnRenamed("step", "b_step")
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(SEGMENT_BITS)])
    probes = segment.select(F.col("id").alias("a"), *(["step"] if rooted else []), "key", F.explode(ball).alias("flip")).where(F.col("key").bitwiseAND(F.col("flip")) == F.col("flip"))
    probes = probes.withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).withColumn("same", F.col("flip") == 0).drop("flip")
    new = (F.col("a") - F.col("step") != F.col("b") - F.col("b_step")) if rooted else F.lit(True)
    # A merge join: it spills, and adaptive execution splits its hot values.
    found = probes.join(table.hint("merge"), "key").where((~F.col("same") | (F.col("a") < F.col("b"))) & new)
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return verified(found, folded, max_distance)


def near_stars(folded: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Written pairs ``a, b``: each member of a bucket and the bucket's smallest id, where they are near."""
    keys = segment_keys(folded)
    # Aggregated before the shuffle and joined, where a window would hold a hot bucket in one task.
    first = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keys.join(first.hint("merge"), "key").where(F.col("a") < F.col("id")).select("a", F.col("id").alias("b")).distinct()
    return materialise(verified(pairs, folded, max_distance).select("a", "b"), "stars")


def with_roots(folded: DataFrame, stars: DataFrame) -> DataFrame:
    """Written ``folded`` with the ``root`` of each id under ``stars``."""
    roots = connected_components(stars).where(F.col("node") != F.col("root")).select(F.col("node").alias("id"), "root")
    return materialise(folded.join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")


def near_edges(folded: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``a, b``: verified pairs that connect whatever ``near_pairs`` connects, but not all pairs of a large group.

    What the stars join has one root; the index is then asked only for pairs
    with different roots, all of them. A pair left out has one root already.
    """
    stars = near_stars(folded, max_distance)
    return stars.union(near_pairs(with_roots(folded, stars), max_distance).select("a", "b"))


def near_groups(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, root`` of every document in a group of two or more; ``root`` is the group's smallest ``doc_id``."""
    prints = materialise(fingerprints(docs), "simhash")
    counted = materialise(prints.groupBy(*SIGNATURE, "segments").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "folded")
    several = counted.where("n > 1").drop("n")
    copies = prints.join(several.hint("merge"), [*SIGNATURE, "segments"]).where(F.col("id") != F.col("doc_id"))
    folded = counted.drop("n")
    stars = near_stars(folded, max_distance)
    labelled = with_roots(folded, stars)
    edges = stars.union(near_pairs(labelled, max_distance).select("a", "b")).union(copies.select("id", "doc_id"))
    groups = connected_components(edges).select(F.col("node").alias("doc_id"), "root")
    # The groups are written, and nothing reads what they came from.
    discard(prints, counted, stars, labelled)
    return groups


def near_dedup(docs: DataFrame, max_distance: int = MAX_DISTANCE, group_size: str | None = None) -> DataFrame:
    """One document of each near-duplicate group and all others; ``group_size`` names a column for the documents it stands for."""
    id_, root_, text_, rank_, tie_, size_ = fresh(docs, "id", "root", "texthash", "rank", "tie", "size")
    groups = near_groups(docs, max_distance)
    sizes = groups.groupBy(F.col("root").alias("doc_id")).agg(F.count("*").alias("size"))
    named = groups.join(sizes.hint("merge"), "doc_id", "left") if group_size else groups.withColumn("size", F.lit(1).cast("long"))
    named = named.select(F.col("doc_id").alias(id_), F.col("root").alias(root_), F.col("size").alias(size_))
    # Hashed before the join, so that texts travel only where they are asked for.
    hashable = [col(f.name) for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    rows = docs.where(col("doc_id").isNotNull()).withColumn(text_, F.xxhash64(col("text"))).withColumn(tie_, F.xxhash64(*hashable))
    # Groups grow with the input: a merge join at every size, never a broadcast.
    left = rows.join(named.hint("merge"), rows["doc_id"] == named[id_], "left").where(col(root_).isNull() | (col(root_) == col("doc_id")))
    # Partitioned by doc_id already; only repeated rows meet here.
    left = left.withColumn(rank_, F.row_number().over(Window.partitionBy(col("doc_id"), col(text_)).orderBy(tie_))).where(col(rank_) == 1)
    kept = left.select(*columns(docs), F.coalesce(col(size_), F.lit(1)).alias(size_)).union(docs.where(col("doc_id").isNull()).select(*columns(docs), F.lit(1).cast("long")))
    return kept.select(*columns(docs), col(size_).alias(group_size)) if group_size else kept.select(*columns(docs))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return near_dedup(docs, group_size="group_size").select("doc_id", "group_size")
