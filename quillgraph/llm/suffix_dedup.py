"""Suffix-array dedup: passages that occur earlier in the corpus, by longest-previous-factor arrays.

A passage is a run of at least ``MIN_WORDS`` words (words end at white
space). A start s has a *previous factor* of that length if the ``MIN_WORDS``
words from s occur at an earlier position, positions being ordered by
(doc_id, word). What previous factors cover is removed; the first occurrence
stays.

One suffix array of the whole corpus does not fit a machine, but two suffixes
that share ``MIN_WORDS`` words share what those words determine: the minimizer
of their runs of ``ANCHOR_WORDS`` words. So

1. each text is cut into stretches of starts that have the same minimizer, and
   the stretches' headers (24 bytes) are shuffled by its hash;
2. hashes that occur once are dropped; for the others the texts give the
   words that their suffixes need, ``MIN_WORDS`` beyond the last start;
3. those are shuffled by hash and sorted. Each hash is a bucket with all
   suffixes that could match: a suffix array is built over its distinct
   contexts, longest previous factors come from the previous and next smaller
   positions in suffix order (the factor with either is the least common
   prefix on the way), and starts whose factor is long enough go out as spans;
4. spans of a document that touch or overlap are merged.

This is exact: no passage is missed and hash collisions only make a bucket
larger, since words are compared. Memory per bucket is that of its distinct
contexts; repeats of one context are told by the sort and cost 16 bytes each.

Result: ``doc_id, start_word, end_word, n_words, source_doc_id, source_word``:
what to remove, and where the first ``MIN_WORDS`` words of it occur first.
``remove_repeats`` returns the documents without it.

Cases: null, empty and short texts have no passage. Rows without a ``doc_id``
cannot be ordered and are left alone. Rows with equal ``doc_id`` count as one
document, the first by text. An empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import col, columns, documents, fresh, map_rows

MIN_WORDS = 50
ANCHOR_WORDS = 25
REMEMBERED = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPAN_SCHEMA = "doc_id long, start_word long, end_word long, source_doc_id long, source_word long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stretches(words: list[str], seen: dict[str, int], min_words: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the minimizer, first start and number of starts of each stretch of a text."""
    n = len(words) - min_words + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    if len(seen) > REMEMBERED:
        seen.clear()
    hashes = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    a = np.array(hashes, dtype=np.uint64)
    # Rolling polynomial hashes modulo 2^64 by prefix sums; the base is odd, so it has an inverse.
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(a * _powers(_BASE, len(a)), dtype=np.uint64)])
    grams = _mix((prefix[anchor_words:] - prefix[:-anchor_words]) * _powers(_BASE_INVERSE, len(a) - anchor_words + 1))
    window = min_words - anchor_words + 1
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]], first, np.diff(np.concatenate([first, [n]]))


def _headers(min_words: int, anchor_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            ids, keys, firsts, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, s, n = stretches(text.as_py().split(), seen, min_words, anchor_words)
                if len(h):
                    ids.append(np.full(len(h), doc_id, dtype=np.int64))
                    keys.append(h)
                    firsts.append(s)
                    counts.append(n)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(firsts).astype(np.int64) << 8 | np.concatenate(counts))],
                    ["key", "doc_id", "stretch"],
                )

    return run


def _contexts(min_words: int):
    """From ``doc_id, text, stretches`` to a row for each stretch with the words its suffixes need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, firsts, counts, texts, size = [], [], [], [], [], 0
            for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = text.as_py().split()
                for x in wanted.as_py():
                    first, n = x["stretch"] >> 8, x["stretch"] & 255
                    keys.append(x["key"])
                    ids.append(doc_id)
                    firsts.append(first)
                    counts.append(n)
                    texts.append(" ".join(words[first : first + n + min_words - 1]))
                    size += len(texts[-1])
                if size > 4_000_000:
                    yield _context_batch(keys, ids, firsts, counts, texts)
                    keys, ids, firsts, counts, texts, size = [], [], [], [], [], 0
            if keys:
                yield _context_batch(keys, ids, firsts, counts, texts)

    return run


def _context_batch(keys, ids, firsts, counts, texts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int32())], ["key", "words", "doc_id", "first", "n"])


def common_words(a: str, b: str) -> int:
    """How many whole words two suffixes (words, each followed by a space) share at their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return a.count(" ", 0, low)


def longest_previous_factors(positions: list, common: list[int]) -> list[int]:
    """LPF by suffix order: ``positions`` of the sorted suffixes, ``common[i]`` the prefix shared by i - 1 and i.

    The longest factor that occurs earlier is shared with the previous or the
    next smaller position in suffix order. One pass with a stack of suffixes
    whose next smaller position is yet to come; each carries the common prefix
    with the one below it.
    """
    n = len(positions)
    lpf = [0] * n
    stack: list[int] = []  # positions rise from bottom to top
    shared: list[int] = []  # with the suffix below
    for i in range(n + 1):
        p = common[i] if 0 < i < n else 0
        while stack and (i == n or positions[stack[-1]] > positions[i]):
            j, with_previous = stack.pop(), shared.pop()
            # p is what j shares with i, its next smaller; below it lies its previous smaller.
            lpf[j] = max(with_previous, p)
            p = min(p, with_previous)
        if i < n:
            stack.append(i)
            shared.append(p)
    return lpf


def bucket_spans(contexts: list[str], owners: list[list[tuple[int, int]]], counts: list[int], min_words: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Spans of one bucket: ``contexts`` are distinct; ``owners`` has the sorted (doc_id, first) of each."""
    suffixes = []
    for c, text in enumerate(contexts):
        text, at = text + " ", 0
        for o in range(counts[c]):
            suffixes.append((text[at:], owners[c][0][0], owners[c][0][1] + o, c, o))
            at = text.index(" ", at) + 1
    suffixes.sort()
    common = [0] + [common_words(suffixes[i - 1][0], suffixes[i][0]) for i in range(1, len(suffixes))]
    positions = [(s[1], s[2]) for s in suffixes]
    lpf = longest_previous_factors(positions, common)
    repeated = [[False] * n for n in counts]
    source = [[(0, 0)] * n for n in counts]
    at = 0
    while at < len(suffixes):
        end = at + 1
        while end < len(suffixes) and common[end] >= min_words:
            end += 1
        earliest = min(positions[at:end])
        for i in range(at, end):
            _, _, _, c, o = suffixes[i]
            repeated[c][o] = lpf[i] >= min_words
            source[c][o] = earliest
        at = end
    for c, own in enumerate(owners):
        for nth, (doc_id, first) in enumerate(own):
            o = 0
            while o < counts[c]:
                # A later occurrence of the same context is repeated throughout.
                if nth == 0 and not repeated[c][o]:
                    o += 1
                    continue
                start = o
                while o < counts[c] and (nth > 0 or repeated[c][o]):
                    o += 1
                yield doc_id, first + start, first + o - 1 + min_words, *source[c][start]


def _spans(min_words: int):
    """From rows sorted by (key, words, doc_id, first) to spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, contexts, owners, counts = None, [], [], []
        out: list[tuple[int, ...]] = []

        def close() -> None:
            if len(contexts) > 1 or owners and len(owners[0]) > 2:
                pairs = [list(zip(o[::2], o[1::2], strict=True)) for o in owners]
                out.extend(bucket_spans(contexts, pairs, counts, min_words))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start_word", "end_word", "source_doc_id", "source_word"])

        for batch in batches:
            for k, words, doc_id, first, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    close()
                    key, contexts, owners, counts = k, [], [], []
                    if len(out) > 50_000:
                        yield flush()
                if not contexts or contexts[-1] != words:
                    contexts.append(words)
                    owners.append(array("q"))
                    counts.append(n)
                owners[-1].append(doc_id)
                owners[-1].append(first)
        close()
        if out:
            yield flush()

    return run


def one_row_each(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` by distinct ``doc_id``; texts without one or without words are left out."""
    rows = docs.where(col("doc_id").isNotNull() & col("text").isNotNull()).select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("nth = 1").select("doc_id", "text")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """What occurs earlier in the corpus, as maximal spans of words ``[start_word, end_word)``."""
    if not 0 < anchor_words <= min_words <= anchor_words + 254:
        raise ValueError("anchor_words lies between 1 and min_words, and 254 below it at most")
    texts = one_row_each(docs)
    headers = texts.mapInArrow(_headers(min_words, anchor_words), "key long, doc_id long, stretch long")
    shared = headers.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    wanted = shared.groupBy("doc_id").agg(F.collect_list(F.struct("key", "stretch")).alias("stretches"))
    # The exchange of texts by doc_id is the one that numbered the rows; Spark reuses it.
    contexts = texts.join(wanted, "doc_id").select("doc_id", "text", "stretches").mapInArrow(_contexts(min_words), "key long, words string, doc_id long, first long, n int")
    sorted_ = contexts.repartition("key").sortWithinPartitions("key", "words", "doc_id", "first")
    spans = sorted_.mapInArrow(_spans(min_words), SPAN_SCHEMA)
    along = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("new", F.coalesce(F.col("start_word") > F.max("end_word").over(before), F.lit(True)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min_by(F.struct("source_doc_id", "source_word"), "start_word").alias("source"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "source.source_doc_id", "source.source_word")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    word = re.compile(r"\S+\s*")
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if text is not None and spans:
                lead = text[: len(text) - len(text.lstrip())]
                words = word.findall(text)
                gone = bytearray(len(words))
                for s in spans:
                    gone[s["start_word"] : s["end_word"]] = b"\1" * (s["end_word"] - s["start_word"])
                text = lead + "".join(w for w, g in zip(words, gone, strict=True) if not g)
            out.append(text)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], [*batch.schema.names[:-2], "cut"])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``docs`` with later copies cut from ``text``; the white space after a removed word goes with it."""
    id_, spans_, text_, cut_ = fresh(docs, "id", "spans", "textcopy", "cut")
    spans = repeated_spans(docs, min_words, anchor_words).groupBy(F.col("doc_id").alias(id_)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans_))
    # Spans are those of the first text of a doc_id; other texts under it are left alone.
    first = F.min("text").over(Window.partitionBy("doc_id"))
    joined = docs.where(col("doc_id").isNotNull()).withColumn(text_, first).join(spans, docs["doc_id"] == F.col(id_), "left")
    joined = joined.withColumn(spans_, F.when(col("text") == col(text_), col(spans_)))
    cut = map_rows(joined.select(*columns(docs), col("text").alias(text_), col(spans_)), _cut, f"{cut_} string", dropped=(text_, spans_))
    return cut.select(*[col(cut_).alias(c) if c == "text" else col(c) for c in docs.columns]).unionByName(docs.where(col("doc_id").isNull()))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+') AS ws
           FROM (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id)),
s AS (SELECT doc_id, ws, unnest(range(len(ws) - {MIN_WORDS - 1})) AS i FROM d WHERE len(ws) >= {MIN_WORDS}),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + {MIN_WORDS}], ' ')) AS w FROM s),
f AS (SELECT doc_id, i, first_value(doc_id) OVER p AS source_doc_id, first_value(i) OVER p AS source_word, row_number() OVER p AS n FROM k WINDOW p AS (PARTITION BY w ORDER BY doc_id, i)),
m AS (SELECT doc_id, i, source_doc_id, source_word, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {MIN_WORDS} THEN 0 ELSE 1 END AS new FROM f WHERE n > 1),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m)
SELECT doc_id, min(i) AS start_word, max(i) + {MIN_WORDS} AS end_word, max(i) + {MIN_WORDS} - min(i) AS n_words,
       arg_min(source_doc_id, i) AS source_doc_id, arg_min(source_word, i) AS source_word
FROM g GROUP BY doc_id, island"""
