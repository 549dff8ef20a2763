"""Where vectors and OCR come from: a contract, a registry, and a provider that needs no network."""

from __future__ import annotations

import hashlib
import json
import math
import os
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32


class ProviderError(Exception):
    """A provider that is unknown, not configured, or failed; its request errors say how."""

    def __init__(self, provider: str, detail: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(f"{provider}: {detail[:300]}")
        self.provider, self.detail, self.status, self.retry_after = provider, detail, status, retry_after


class EmbeddingProvider(Protocol):
    name: str
    model: str
    dimension: int

    def configuration_issue(self) -> str | None: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class OcrProvider(Protocol):
    name: str
    ocr_model: str

    def configuration_issue(self) -> str | None: ...

    def ocr(self, payload: dict) -> dict: ...


def retry_seconds(header: str | None) -> float | None:
    """The seconds of a retry header; dates and others give None."""
    try:
        return float(header) if header is not None else None
    except ValueError:
        return None


class HttpProvider:
    """A hosted service with bearer authentication: POST of JSON to a path for embeddings and one for OCR.

    The key is read from an environment variable when a call is made, so that it
    travels to no executor with the code. Failures of network and service become
    ProviderError; no other provider is tried.
    """

    def __init__(self, name: str, base_url: str, key_variable: str, model: str, dimension: int, ocr_model: str | None = None, embeddings_path: str = "/embeddings", ocr_path: str = "/ocr", seconds: float = 60.0, ocr_seconds: float = 300.0):
        self.name, self.base_url, self.key_variable = name, base_url.rstrip("/"), key_variable
        self.model, self.dimension, self.ocr_model = model, dimension, ocr_model
        self.embeddings_path, self.ocr_path, self.seconds, self.ocr_seconds = embeddings_path, ocr_path, seconds, ocr_seconds

    def configuration_issue(self) -> str | None:
        return None if os.environ.get(self.key_variable) else f"{self.key_variable} is not set"

    def _post(self, path: str, body: dict, seconds: float) -> dict:
        asked = urllib.request.Request(self.base_url + path, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"})
        try:
            with urllib.request.urlopen(asked, timeout=seconds) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as trouble:
            raise ProviderError(self.name, trouble.read().decode("utf-8", "replace"), trouble.code, retry_seconds(trouble.headers.get("Retry-After"))) from trouble
        except (OSError, ValueError) as trouble:
            raise ProviderError(self.name, str(trouble)) from trouble

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors in the order of the texts, whatever the order of the answer."""
        found = self._post(self.embeddings_path, {"model": self.model, "input": texts}, self.seconds)["data"]
        if len(found) != len(texts):
            raise ProviderError(self.name, f"{len(found)} vectors for {len(texts)} texts")
        return [x["embedding"] for x in sorted(found, key=lambda x: x["index"])]

    def ocr(self, payload: dict) -> dict:
        """(pages, model, pages_processed) of a document, pages in the order of their index."""
        if not self.ocr_model:
            raise ProviderError(self.name, "no OCR model")
        answer = self._post(self.ocr_path, {"model": self.ocr_model, "document": payload}, self.ocr_seconds)
        pages = [p["markdown"] for p in sorted(answer["pages"], key=lambda p: p["index"])]
        return {"pages": pages, "model": answer.get("model", self.ocr_model), "pages_processed": (answer.get("usage_info") or {}).get("pages_processed")}


class HashProvider:
    """Vectors of signed word hashes: deterministic, local, and no match for a trained model's."""

    name, model, dimension = "local", "hash-64", 64

    def configuration_issue(self) -> str | None:
        return None

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(t) for t in texts]

    def _vector(self, text: str) -> list[float]:
        v = [0.0] * self.dimension
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            v[h % self.dimension] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else v


PROVIDERS: dict[str, EmbeddingProvider] = {"local": HashProvider()}


def resolve(name: str) -> EmbeddingProvider:
    """The provider of that name, ready for use; there is no fallback to another."""
    if name not in PROVIDERS:
        raise ProviderError(name, f"unknown provider; known: {', '.join(sorted(PROVIDERS))}")
    if issue := PROVIDERS[name].configuration_issue():
        raise ProviderError(name, issue)
    return PROVIDERS[name]


def describe() -> list[dict]:
    """Every provider with its state, without any call."""
    return [{"name": p.name, "base_url": getattr(p, "base_url", None), "configured": p.configuration_issue() is None, "issue": p.configuration_issue(), "embedding_model": p.model, "ocr_model": getattr(p, "ocr_model", None)} for p in PROVIDERS.values()]


def register(provider: EmbeddingProvider) -> None:
    PROVIDERS[provider.name] = provider


def embedded(rows: DataFrame, key: str, text: str, provider: EmbeddingProvider) -> DataFrame:
    """(key, vector): each row's text embedded, a few texts a call, calls of one partition one after another."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list[list[float]] = []
            for at in range(0, len(f), BATCH):
                vectors += provider.embed(f["t"].iloc[at : at + BATCH].tolist())
            yield pd.DataFrame({"key": f["key"], "vector": vectors})

    return rows.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInPandas(run, f"key {kind}, vector array<float>")
