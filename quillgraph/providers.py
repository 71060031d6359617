"""Language-model providers behind one method: ``complete(messages) -> str``.

A provider is pickled to the workers that call it, so it holds settings, not
connections. ``ScriptedProvider`` answers from a table and needs no network.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

from quillgraph.errors import ProviderError

Messages = list[dict[str, str]]


class Provider(Protocol):
    def complete(self, messages: Messages, temperature: float = 0.0, max_tokens: int = 1000) -> str: ...


@dataclass
class ScriptedProvider:
    """The first reply whose key occurs in the last message; ``default`` where none does."""

    replies: dict[str, str] = field(default_factory=dict)
    default: str = ""

    def complete(self, messages: Messages, temperature: float = 0.0, max_tokens: int = 1000) -> str:
        said = messages[-1]["content"]
        return next((v for k, v in self.replies.items() if k in said), self.default)

    def list_models(self) -> list[str]:
        return ["scripted"]

    def stream(self, messages: Messages, **options) -> Iterator[str]:
        yield from self.complete(messages, **options).split(" ")


@dataclass
class HttpProvider:
    """Chat completions over HTTP. Connection faults are retried with a growing pause, refusals are not."""

    url: str
    model: str
    key_variable: str | None = None
    style: str = "openai"
    attempts: int = 3
    timeout: float = 60.0

    def _request(self, path: str, body: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json"}
        key = os.environ.get(self.key_variable or "")
        if self.key_variable and not key:
            raise ProviderError(f"{self.key_variable} is not set")
        if key:
            headers |= {"x-api-key": key, "anthropic-version": "2023-06-01"} if self.style == "messages" else {"Authorization": f"Bearer {key}"}
        request = urllib.request.Request(self.url + path, data=None if body is None else json.dumps(body).encode(), headers=headers)
        for n in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                raise ProviderError(f"{self.url}: {e.code}") from e
            except (urllib.error.URLError, TimeoutError) as e:
                if n == self.attempts - 1:
                    raise ProviderError(f"{self.url}: {e}") from e
                time.sleep(2**n)
        raise ProviderError(self.url)

    def complete(self, messages: Messages, temperature: float = 0.0, max_tokens: int = 1000) -> str:
        body = {"model": self.model, "temperature": temperature, "max_tokens": max_tokens}
        if self.style == "messages":
            system = "\n".join(m["content"] for m in messages if m["role"] == "system")
            r = self._request("/messages", body | {"system": system, "messages": [m for m in messages if m["role"] != "system"]})
            return "".join(x.get("text", "") for x in r.get("content", []))
        if self.style == "local":
            return self._request("/api/chat", {"options": {"num_predict": max_tokens, "temperature": temperature}, "stream": False, "messages": messages, "model": self.model})["message"]["content"]
        first = self._request("/chat/completions", body | {"messages": messages})["choices"][0]
        return first["message"]["content"] or ""

    def list_models(self) -> list[str]:
        r = self._request("/api/tags" if self.style == "local" else "/models")
        return sorted(m.get("id") or m.get("name") for m in r.get("data") or r.get("models") or [])

    def stream(self, messages: Messages, **options) -> Iterator[str]:
        yield self.complete(messages, **options)


#: Name: (style, address, model, variable of the key).
KNOWN = {
    "groq": ("openai", "https://api.groq.com/openai/v1", "llama-3.3-70b-versatile", "GROQ_API_KEY"),
    "openai": ("openai", "https://api.openai.com/v1", "gpt-4o-mini", "OPENAI_API_KEY"),
    "anthropic": ("messages", "https://api.anthropic.com/v1", "claude-3-5-haiku-latest", "ANTHROPIC_API_KEY"),
    "inception": ("openai", "https://api.inceptionlabs.ai/v1", "mercury", "INCEPTION_API_KEY"),
    "ollama": ("local", "http://localhost:11434", "llama3.2", None),
}
ALIASES = {"mercury": "inception"}


def provider(name: str, model: str | None = None) -> Provider | None:
    """A provider by name; "none" for none, "scripted" for an empty script."""
    name = ALIASES.get(name.lower(), name.lower())
    if name == "none":
        return None
    if name == "scripted":
        return ScriptedProvider()
    if name not in KNOWN:
        raise ProviderError(f"unknown provider {name!r}; known are {', '.join(sorted(KNOWN))}")
    style, url, default, key = KNOWN[name]
    return HttpProvider(url, model or default, key, style)
