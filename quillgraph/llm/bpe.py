"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut before encoding, only at *safe* boundaries: between a
character that is no white space and one that is, or after a run of letters or
digits where another class begins. The split pattern ends a piece at each of
these places whatever surrounds them, so the tokens of the parts are the
tokens of the whole. Decoding joins the bytes of the tokens; a token may be
part of a character, so nothing is decoded to text before the bytes are joined.

Cases: a null text has null tokens and a null count; an empty text has none
(an empty list, 0); ``round_trip`` is null for a null text. Strings that look like special tokens are ordinary text.
Repeated rows are encoded row by row; an empty table gives an empty table.
Extra columns are carried along; ``tokens``, ``n_tokens`` (and ``decoded``)
replace columns of these names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import col, documents, map_rows

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters beyond which a text is cut for encoding.
PART_CHARS = 32_768

_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")


@lru_cache(maxsize=4)
def encoding(rank_file: str = RANK_FILE, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """``text`` in parts of about ``part_chars``, cut at safe boundaries; a run without one stays whole."""
    if len(text) <= part_chars:
        return [text]
    parts, at = [], 0
    while len(text) - at > part_chars:
        m = _SAFE.search(text, at + part_chars)
        if m is None or m.start() >= len(text):
            break
        parts.append(text[at : m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


def encode(text: str, enc: tiktoken.Encoding, part_chars: int = PART_CHARS) -> list[int]:
    parts = safe_parts(text, part_chars)
    return enc.encode_ordinary(text) if len(parts) == 1 else list(chain.from_iterable(map(enc.encode_ordinary, parts)))


def encoder(rank_file: str, part_chars: int = PART_CHARS, rows: int = 256, at_col: int = 1, keep_text: bool = True, verify: bool = False):
    """For mapInArrow: the columns as they are (the text in ``at_col`` if ``keep_text``), then tokens, n_tokens and, to ``verify``, whether the tokens decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                values, sizes, nulls, same = [], [], [], []
                for text in batch.column(at_col).to_pylist():
                    tokens = [] if text is None else encode(text, enc, part_chars)
                    values.append(np.array(tokens, dtype=np.int32))
                    sizes.append(len(tokens))
                    nulls.append(text is None)
                    same.append(None if text is None else verify and enc.decode_bytes(tokens) == text.encode())
                mask = pa.array(nulls, pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(values)), mask=mask)
                counts = pa.array(np.array(sizes, dtype=np.int64), mask=np.array(nulls, dtype=bool))
                kept = [i for i in range(batch.num_columns) if keep_text or i != at_col]
                out, names = [*[batch.column(i) for i in kept], lists, counts], [*[batch.schema.names[i] for i in kept], "tokens", "n_tokens"]
                if verify:
                    out.append(pa.array(same, pa.bool_()))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def bpe_encode(docs: DataFrame, rank_file: str = RANK_FILE, part_chars: int = PART_CHARS, keep_text: bool = True, verify: bool = False) -> DataFrame:
    """``docs`` (``keep_text``: with its text) with ``tokens array<int>``, ``n_tokens long`` and, to ``verify``, ``round_trip boolean``."""
    added = ["tokens", "n_tokens", *(["round_trip"] if verify else [])]
    keep = [c for c in docs.columns if c.lower() not in added]
    run = encoder(rank_file, part_chars, at_col=keep.index("text"), keep_text=keep_text, verify=verify)
    schema = "tokens array<int>, n_tokens long" + (", round_trip boolean" if verify else "")
    return map_rows(docs.select(*[col(c) for c in keep]), run, schema, dropped=() if keep_text else ("text",))


def decoder(rank_file: str, rows: int = 256, at_col: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                out = [None if t is None else enc.decode_bytes(t) for t in batch.column(at_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def bpe_decode(tokens: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """``tokens`` with ``decoded binary``, the joined bytes of the column ``tokens``."""
    keep = [c for c in tokens.columns if c.lower() != "decoded"]
    return map_rows(tokens.select(*[col(c) for c in keep]), decoder(rank_file, at_col=keep.index("tokens")), "decoded binary")


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and whether their bytes decode to its text."""
    return bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False, verify=True)
