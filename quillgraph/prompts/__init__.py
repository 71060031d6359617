"""Prompts by name: a file named in the environment, else the text below."""

from __future__ import annotations

import os
from functools import lru_cache
from pathlib import Path

DEFAULTS = {
    "extract": "List the facts that the text states, as a JSON array. Each has subject, predicate, object (a named thing) or object_value (anything else), context (its sentence) and confidence from 0 to 1. Say nothing else.",
    "decompose": "Split the question into at most {n} questions that can be answered one by one, as a JSON array of strings. Say nothing else.",
    "synthesize": 'Answer from the numbered facts alone. Reply with JSON: {"a": the answer, "f": [labels of the facts used]}. Without facts that answer, the answer is "unknown".',
}


@lru_cache(maxsize=32)
def prompt(name: str) -> str:
    path = os.environ.get(f"QUILLGRAPH_PROMPT_{name.upper()}")
    return Path(path).read_text() if path else DEFAULTS[name]
