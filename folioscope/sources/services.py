"""Model services behind small interfaces: configuration, deterministic mocks, and an HTTP client for real ones."""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from dataclasses import dataclass, field
from typing import Any, Protocol


class Chat(Protocol):
    def complete(self, messages: list[dict[str, str]]) -> tuple[str, dict[str, int]]: ...


class Embed(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Rerank(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]: ...


@dataclass(frozen=True)
class Service:
    name: str
    provider: str
    model: str
    base_url: str = ""
    settings: dict[str, Any] = field(default_factory=dict)


def resolve(config: dict[str, Any], name: str, overrides: dict[str, Any] | None = None) -> Service:
    """A service's settings: its profile's values under its own, its provider's address, overrides on top."""
    services = config.get("services", {})
    if name not in services:
        raise KeyError(f"missing model service: {name}")
    own, profiles = dict(services[name]), config.get("profiles", {})
    chosen = own.pop("profile", None)
    if chosen and chosen not in profiles:
        raise KeyError(f"unknown profile of {name}: {chosen}")
    merged = {**(profiles[chosen] if chosen else {}), **own, **(overrides or {})}
    provider = merged.pop("provider", None)
    if not provider:
        raise ValueError(f"model service without a provider: {name}")
    known = config.get("providers", {}).get(provider)
    if known is None and provider != "mock":
        raise KeyError(f"unknown provider of {name}: {provider}")
    known = known or {}
    return Service(name, provider, merged.pop("model", ""), known.get("base_url", ""), {**known, **merged})


def usage(raw: dict[str, Any]) -> dict[str, int]:
    """Token counts under one set of names."""
    pick = lambda *names: next((int(raw[n]) for n in names if raw.get(n) is not None), 0)
    got = {"input_tokens": pick("input_tokens", "prompt_tokens"), "output_tokens": pick("output_tokens", "completion_tokens")}
    return got | {"total_tokens": pick("total_tokens") or sum(got.values())}


class HashEmbedder:
    """Vectors from chained SHA-256 digests: the Python twin of the expression."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        raw = b"".join(hashlib.sha256(text.encode() + k.to_bytes(4, "big")).digest() for k in range(math.ceil(self.dimensions / 32)))
        v = [b / 255.0 - 0.5 for b in raw[: self.dimensions]]
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]


class OverlapReranker:
    """Scores by the share of the query's words and letter pairs that a document holds."""

    @staticmethod
    def terms(text: str) -> set[str]:
        flat = "".join(text.lower().split())
        return {*re.findall(r"[a-z0-9_]+", flat), *(flat[k : k + 2] for k in range(len(flat) - 1))}

    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        asked = self.terms(query)
        scores = [(k, round(len(asked & self.terms(d)) / max(1, len(asked)), 8)) for k, d in enumerate(documents)]
        return sorted(scores, key=lambda s: -s[1])


class ScriptedChat:
    """Answers from a list, the last one again and again."""

    def __init__(self, answers: list[str]):
        self.answers, self.calls = answers, 0

    def complete(self, messages: list[dict[str, str]]) -> tuple[str, dict[str, int]]:
        self.calls += 1
        return self.answers[min(self.calls, len(self.answers)) - 1], {"input_tokens": sum(len(m["content"]) for m in messages) // 4 or 1, "output_tokens": 1}


class HttpService:
    """A service with an OpenAI-like interface."""

    def __init__(self, service: Service, key: str):
        self.service, self.key = service, key

    def _post(self, path: str, body: dict[str, Any]) -> dict[str, Any]:
        head = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        request = urllib.request.Request(self.service.base_url.rstrip("/") + path, json.dumps(body).encode(), head)
        with urllib.request.urlopen(request, timeout=float(self.service.settings.get("timeout", 60))) as answer:
            return json.load(answer)

    def complete(self, messages: list[dict[str, str]]) -> tuple[str, dict[str, int]]:
        got = self._post("/chat/completions", {"model": self.service.model, "messages": messages, "temperature": self.service.settings.get("temperature", 0)})
        return got["choices"][0]["message"]["content"], usage(got.get("usage", {}))

    def embed(self, texts: list[str]) -> list[list[float]]:
        got = self._post("/embeddings", {"model": self.service.model, "input": texts})["data"]
        return [d["embedding"] for d in sorted(got, key=lambda d: d["index"])]

    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        got = self._post("/rerank", {"model": self.service.model, "query": query, "documents": documents})["results"]
        pairs = [(r.get("index"), r.get("relevance_score", r.get("score"))) for r in got]
        return [(int(k), float(s)) for k, s in pairs if k is not None and s is not None]


def make(service: Service, key: str = ""):
    """A client for a service; `mock` ones need no network."""
    if service.provider != "mock":
        return HttpService(service, key)
    kind = service.settings.get("kind", service.name)
    if kind == "embedding":
        return HashEmbedder(int(service.settings.get("dimensions", 64)))
    return OverlapReranker() if kind == "rerank" else ScriptedChat(["{}"])
