"""From chunks to raw facts: the one place where ingestion asks a language model, and what cleans up after it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RAW_SCHEMA = "pos int, subject string, predicate string, object string, object_value string, context string, confidence double"
MIN_CONFIDENCE = 0.6
MAX_PER_SEGMENT = 50

_FENCES = re.compile(r"^`{3}(?:json)?\s*|`{3}\s*$")


def scan_objects(text: str) -> list[dict]:
    """The complete JSON objects in a text, whatever stands around and between them."""
    decoder, found, at = json.JSONDecoder(), [], text.find("{")
    while at >= 0:
        try:
            obj, end = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            end = at + 1
        else:
            found.append(obj)
        at = text.find("{", end)
    return found


def parse_facts(response: str | None) -> list[dict]:
    """Facts in a model's response: an array, an object, objects in a row, or what is whole of a damaged text."""
    text = _FENCES.sub("", (response or "").strip()).strip()
    for attempt in (text, f"[{text}]"):
        try:
            parsed = json.loads(attempt)
        except json.JSONDecodeError:
            continue
        return clean_facts(parsed if isinstance(parsed, list) else [parsed])
    return clean_facts(scan_objects(text))


def clean_facts(items: list) -> list[dict]:
    """Those with subject and predicate; confidences end up in [0, 1], 1 where there is no number."""
    out = []
    as_text = lambda v: None if v is None else str(v).strip()
    for x in items:
        if not isinstance(x, dict) or not x.get("subject") or not x.get("predicate"):
            continue
        try:
            sure = min(1.0, max(0.0, float(x.get("confidence", 1.0))))
        except (TypeError, ValueError):
            sure = 1.0
        out.append({"subject": as_text(x["subject"]), "predicate": as_text(x["predicate"]), "object": as_text(x.get("object")), "object_value": as_text(x.get("object_value")), "context": as_text(x.get("context")) or "", "confidence": sure})
    return out


def parse_responses(responses: DataFrame, key: str, column: str = "response") -> DataFrame:
    """``key, pos`` and the fact columns, a row for each fact in a response."""
    kind = responses.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, i, *f.values()) for k, r in zip(pdf[key], pdf[column], strict=True) for i, f in enumerate(parse_facts(r))]
            yield pd.DataFrame(rows, columns=[key, "pos", "subject", "predicate", "object", "object_value", "context", "confidence"])

    return responses.select(key, column).mapInPandas(run, f"{key} {kind}, {RAW_SCHEMA}")


def cap(raw: DataFrame, segment: str, min_confidence: float = MIN_CONFIDENCE, per_segment: int = MAX_PER_SEGMENT) -> DataFrame:
    """Facts at or above a confidence, the first of each segment in the order of ``pos``."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(confidence AS DOUBLE)"), F.lit(1.0))))
    kept = raw.withColumn("confidence", sure).where(F.col("confidence") >= min_confidence)
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy(segment).orderBy("pos"))).where(F.col("__n") <= per_segment).drop("__n")


def batches(chunks: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, batch, contents``: the chunks of a document in groups of ``size``, in order, for one call each."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    numbered = chunks.withColumn("batch", F.floor((n - 1) / size))
    order = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return numbered.groupBy("doc_id", "batch").agg(F.transform(order, lambda x: x["content"]).alias("contents"))


def extract(chunks: DataFrame, complete: Callable[[list[dict]], str], prompt: str, concurrency: int = 8) -> DataFrame:
    """Facts of ``chunks`` (doc_id, source, chunk_index, content), each with its own provenance.

    ``complete`` takes chat messages and returns text; it is pickled to the
    workers, at most ``concurrency`` of which call it at a time. An empty
    response is asked for once more; errors give no facts for that chunk.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                messages = [dict(role="system", content=prompt), dict(role="user", content=r.content)]
                facts: list[dict] = []
                for _ in range(2):
                    try:
                        response = complete(messages)
                    except Exception:  # a provider may raise anything; the chunk is then without facts
                        break
                    if response and response.strip():
                        facts = parse_facts(response)
                        break
                rows += [(r.doc_id, r.source, r.chunk_index, i, f["subject"], f["predicate"], f["object"], f["object_value"], f["context"] or r.content, f["confidence"]) for i, f in enumerate(facts)]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "chunk_index", "pos", "subject", "predicate", "object", "object_value", "context", "confidence"])

    schema = "doc_id string, source string, chunk_index int, pos int, subject string, predicate string, object string, object_value string, context string, confidence double"
    return chunks.select("doc_id", "source", "chunk_index", "content").repartition(concurrency, "doc_id", "chunk_index").mapInPandas(run, schema)
