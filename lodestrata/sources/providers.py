"""Interfaces to outside services, and deterministic stand-ins for tests."""

from __future__ import annotations

import hashlib
import math
from typing import Protocol


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    def __call__(self, queries: list[str], contents: list[str]) -> list[float]: ...


class Writer(Protocol):
    def __call__(self, prompt: str) -> str: ...


def hash_embedder(size: int = 32) -> Embedder:
    """Vectors from hashed words: equal texts have equal vectors, shared words bring texts closer."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def overlap_scorer(queries: list[str], contents: list[str]) -> list[float]:
    """Share of a query's words that a content holds."""
    out = []
    for q, c in zip(queries, contents):
        a, b = set((q or "").lower().split()), set((c or "").lower().split())
        out.append(len(a & b) / len(a) if a else 0.0)
    return out
