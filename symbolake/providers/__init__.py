"""Embedding providers: a registry of objects that turn texts into unit vectors.

Keyed services are called from the driver, one batch after another, because key
rotation and save-on-failure are ordered; keys never enter a plan or a closure.
The on-device provider runs on the executors (see ``embed_table``).
"""

from __future__ import annotations

import json
import math
import os
import sys
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


class EmbeddingError(RuntimeError):
    """A provider call failed."""


class QuotaExhausted(EmbeddingError):
    """The key has no quota left; another may have."""


class InvalidKey(EmbeddingError):
    """The key or the request was refused; no other key is tried."""


@dataclass(frozen=True)
class Request:
    texts: tuple[str, ...]
    task: str  # "document" or "query"
    model: str
    dim: int
    timeout: float = 60.0


@dataclass
class Response:
    status_code: int
    text: str

    def json(self):
        return json.loads(self.text)


def post(url: str, headers: dict, body: dict, timeout: float) -> Response:
    call = urllib.request.Request(url, json.dumps(body).encode(), {**headers, "content-type": "application/json"})
    try:
        with urllib.request.urlopen(call, timeout=timeout) as r:
            return Response(r.status, r.read().decode())
    except urllib.error.HTTPError as e:
        return Response(e.code, e.read().decode(errors="replace"))
    except OSError as e:
        raise EmbeddingError(f"no connection to {url.split('/')[2]}: {e}") from e


def unit(vector) -> list[float]:
    norm = math.sqrt(sum(x * x for x in vector))
    return [x / norm for x in vector] if norm else [*vector]


def checked(response, service: str):
    """The body of a good response; the error class says what a caller may do."""
    code = response.status_code
    if code == 200:
        return response.json()
    if code == 429:
        raise QuotaExhausted(f"{service}: quota exhausted (HTTP 429)")
    if code in (400, 401, 403):
        try:
            said = (response.json().get("error") or {}).get("message")
        except ValueError:
            said = None
        raise InvalidKey(said or f"{service}: HTTP {code}")
    raise EmbeddingError(f"{service}: unexpected answer (HTTP {code}): {response.text[:300]}")


class Gemini:
    # The service's interface.
    name, model, dim, variable = "gemini", "gemini-embedding-001", 768, "GEMINI_API_KEY"
    base = "https://generativelanguage.googleapis.com/v1beta/models"
    tasks = {"document": "RETRIEVAL_DOCUMENT", "query": "RETRIEVAL_QUERY"}

    def embed(self, request: Request, key: str, http_post: Callable = post) -> list[list[float]]:
        full = f"models/{request.model}"
        items = [{"model": full, "content": {"parts": [{"text": t}]}, "taskType": self.tasks[request.task], "outputDimensionality": request.dim} for t in request.texts]
        got = checked(http_post(f"{self.base}/{request.model}:batchEmbedContents", {"x-goog-api-key": key}, {"requests": items}, request.timeout), self.name)
        return [unit(e["values"]) for e in got["embeddings"]]


class OpenAI:
    # The service's interface.
    name, model, dim, variable = "openai", "text-embedding-3-small", 768, "OPENAI_API_KEY"
    base = "https://api.openai.com/v1/embeddings"

    def embed(self, request: Request, key: str, http_post: Callable = post) -> list[list[float]]:
        body = {"model": request.model, "input": [*request.texts], "dimensions": request.dim}
        got = checked(http_post(self.base, {"Authorization": f"Bearer {key}"}, body, request.timeout), self.name)
        return [unit(e["embedding"]) for e in got["data"]]


def local_vectors(model: str, texts) -> list[list[float]]:
    try:
        from fastembed import TextEmbedding
    except ImportError as e:
        raise EmbeddingError("the local provider needs fastembed: pip install fastembed") from e
    return [[float(x) for x in v] for v in TextEmbedding(model_name=model).embed([*texts])]


class Local:
    # The default on-device model.
    name, model, dim, variable = "local", "BAAI/bge-small-en-v1.5", 384, None

    def __init__(self, vectors: Callable = local_vectors):
        self.vectors = vectors

    def embed(self, request: Request, key: str = "", http_post: Callable | None = None) -> list[list[float]]:
        return [unit(v) for v in self.vectors(request.model, request.texts)]


REGISTRY = {p.name: p for p in (Gemini(), OpenAI(), Local())}


def provider(name: str):
    if name not in REGISTRY:
        raise ValueError(f"unknown provider {name!r}; available: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def keys(variable: str | None) -> list[str]:
    """Keys from the environment: the plural variable (a comma list), else the singular one."""
    if not variable:
        return [""]
    several = [k.strip() for k in os.environ.get(f"{variable}S", "").split(",")]
    found = [k for k in several if k]
    one = os.environ.get(variable)
    return found or ([one] if one else [])


class Rotation:
    """Tries keys in order; a key without quota is dropped for good, a refused one ends the work."""

    def __init__(self, source, given: list[str], say: Callable[[str], None] | None = None):
        self.source, self.left, self.total = source, [*given], len(given)
        self.say = say or (lambda line: print(line, file=sys.stderr))

    def embed(self, request: Request, **options) -> list[list[float]]:
        while True:
            try:
                return self.source.embed(request, self.left[0], **options)
            except QuotaExhausted:
                if len(self.left) == 1:
                    raise
                at = self.total - len(self.left) + 1
                self.say(f"key {at} of {self.total} has no quota left (HTTP 429), going on with key {at + 1}")
                self.left.pop(0)


def embed_table(entries: DataFrame, source, model: str, dim: int | None = None, batch: int = 50) -> DataFrame:
    """key and vector of every (key, text), by a provider that needs no key, on the executors."""

    def run(batches):
        for part in batches:
            texts = part.column(1).to_pylist()
            out: list[list[float]] = []
            for i in range(0, len(texts), batch):
                out += source.embed(Request(tuple(texts[i : i + batch]), "document", model, dim or source.dim))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.float64()))], ["key", "vector"])

    return entries.select("key", "text").mapInArrow(run, "key string, vector array<double>")
