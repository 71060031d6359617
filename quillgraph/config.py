"""Settings of a knowledge base, from keywords, a mapping, the environment or YAML, and a user's saved choices."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

from quillgraph.errors import ConfigError

PREFIX = "QUILLGRAPH_"


@dataclass(frozen=True)
class Config:
    kb_dir: str = "./quillgraph_kb"
    chunk_tokens: int = 300
    max_facts_per_segment: int = 50
    fact_confidence_threshold: float = 0.6
    min_confidence: float = 0.5
    hop_depth: int = 2
    max_subgraph_nodes: int = 50
    max_subquestions: int = 5
    top_seeds: int = 3
    max_seeds: int = 10
    token_budget: int = 600
    query_cache: bool = True
    query_cache_ttl: int = 3600
    fuzzy_threshold: float = 85.0
    provider: str = "none"
    model: str | None = None
    temperature: float = 0.0
    max_tokens: int = 1000
    concurrency: int = 8

    def __post_init__(self) -> None:
        object.__setattr__(self, "max_subgraph_nodes", max(5, self.max_subgraph_nodes))
        if not 0 <= self.min_confidence <= 1 or not 0 <= self.fact_confidence_threshold <= 1:
            raise ConfigError("confidences lie between 0 and 1")

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> Config:
        """Unknown keys are left alone; strings are read as the field's type."""
        kinds = {f.name: f.type for f in fields(cls)}
        return cls(**{k: _typed(kinds[k], k, v) for k, v in values.items() if k in kinds})

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        return cls.from_dict({k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)})

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        return cls.from_dict((yaml.safe_load(Path(path).read_text()) or {}).get("quillgraph") or {})

    def as_mapping(self) -> dict[str, Any]:
        return asdict(self)


def _typed(kind: str, name: str, value: Any) -> Any:
    if not isinstance(value, str) or "str" in kind:
        return value
    try:
        if kind == "bool":
            return value.strip().lower() in ("1", "true", "yes")
        return int(value) if kind == "int" else float(value)
    except ValueError:
        raise ConfigError(f"{name} is {value!r}, which is no {kind}") from None


def user_file() -> Path:
    return Path(os.environ.get(PREFIX + "HOME", Path.home() / ".quillgraph")) / "config.json"


def load_user(path: Path | None = None) -> dict[str, Any]:
    path = path or user_file()
    try:
        found = json.loads(path.read_text())
    except (OSError, json.JSONDecodeError):
        return {}
    return found if isinstance(found, dict) else {}


def save_user(values: dict[str, Any], path: Path | None = None) -> Path:
    """Merge into what is saved; the file is replaced whole and readable by its owner alone."""
    path = path or user_file()
    path.parent.mkdir(parents=True, exist_ok=True)
    own = path.with_suffix(".new")
    fd = os.open(own, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(fd, "w") as f:
        json.dump(load_user(path) | values, f, indent=2)
    os.replace(own, path)
    return path
