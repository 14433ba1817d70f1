"""Text to vector: a pluggable embedder, with a deterministic one that needs no model."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CACHED = 100


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Word counts, each word added or subtracted at a place given by its hash, scaled to length 1."""

    def __init__(self, dimensions: int = 128) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out.tolist()


class LetterEmbedder:
    """How often each letter from a to z occurs; simple enough for SQL."""

    dimensions = 26

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)[97:123].astype(np.float64).tolist() for t in texts]


class HttpEmbedder:
    """Asks a service for vectors: POST {"model": ..., "input": [texts]} to <server>/api/embed
    gives {"embeddings": [vectors]}. Columns are embedded on the executors, ``batch`` texts
    a request; a request that fails is made again, ``attempts`` times in all."""

    def __init__(self, server: str, model: str, dimensions: int, batch: int = 32, attempts: int = 3, timeout: float = 60.0) -> None:
        server = server if server.startswith(("http://", "https://")) else f"http://{server}"
        self.url, self.model, self.dimensions = f"{server.rstrip('/')}/api/embed", model, dimensions
        self.batch, self.attempts, self.timeout = batch, attempts, timeout

    def _ask(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        for attempt in range(1, self.attempts + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
                    found = json.load(answer).get("embeddings") or []
                break
            except OSError:
                if attempt == self.attempts:
                    raise
        if len(found) != len(texts) or any(len(v) != self.dimensions for v in found):
            raise ValueError(f"{self.model} doesn't give a vector of {self.dimensions} dimensions for each text")
        return [[float(x) for x in v] for v in found]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for at in range(0, len(texts), self.batch) for v in self._ask(texts[at : at + self.batch])]


def embedded(text: Column, embedder: Embedder) -> Column:
    """A column of vectors, made in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.fillna("").tolist()), dtype="object")

    return F.pandas_udf(run, "array<double>")(text)


class QueryEmbedder:
    """Embeds the texts of searches, and remembers the last hundred."""

    def __init__(self, embedder: Embedder) -> None:
        self.embedder = embedder
        self._one = lru_cache(CACHED)(lambda text: tuple(embedder.embed([text])[0]))

    def __call__(self, text: str) -> list[float]:
        return list(self._one(text))

    def cache_info(self):
        return self._one.cache_info()
