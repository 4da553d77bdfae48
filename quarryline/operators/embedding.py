"""Embedding providers and their use on tables of texts.

A provider turns a list of texts into vectors, in order. Providers that call a service share their rate over the tasks that
run at once, retry what may pass, and check what comes back; rows are embedded in Arrow batches on the executors.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import IDENTIFIER

DOCUMENT, QUERY = "document", "query"


class EmbeddingError(RuntimeError):
    """The provider gave no usable vectors."""


@dataclass
class Bucket:
    """A token bucket: take(n) waits until n units are there; more than its size counts as its size."""

    per_second: float
    size: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    level: float = field(default=0.0, init=False)
    last: float = field(default=0.0, init=False)

    def __post_init__(self):
        self.level, self.last = self.size, self.clock()

    def take(self, n: float) -> None:
        if self.per_second <= 0:
            return
        n = min(n, self.size)
        now = self.clock()
        self.level = min(self.size, self.level + (now - self.last) * self.per_second)
        self.last = now
        if self.level < n:
            wait = (n - self.level) / self.per_second
            self.sleep(wait)
            self.level, self.last = n, self.last + wait
        self.level -= n


def with_retries(call: Callable[[], bytes], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """call() again after 429 (as told, else 10, 15, 25, 45 seconds) and after 502, 503, 504 or a network fault (half a second, doubling)."""
    for k in range(attempts):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if k == attempts - 1 or e.code not in (429, 502, 503, 504):
                raise
            told = (e.headers or {}).get("Retry-After", "")
            sleep((float(told) if told.isdigit() else 5.0 * 2**k + 5) if e.code == 429 else 0.5 * 2**k)
        except TimeoutError:
            raise
        except (urllib.error.URLError, ConnectionError) as e:
            if k == attempts - 1 or isinstance(getattr(e, "reason", None), TimeoutError):
                raise
            sleep(0.5 * 2**k)
    raise AssertionError("unreachable")


def estimate(text: str, extra: int = 0) -> int:
    return max(1, len(text.encode()) // 3 + extra)


def batches_of(texts: list[str], most: int, most_tokens: int = 0) -> Iterator[list[str]]:
    """Successive batches of at most `most` texts and `most_tokens` estimated tokens (0: any), at least one text each."""
    batch: list[str] = []
    tokens = 0
    for text in texts:
        n = estimate(text, 1) if most_tokens else 0
        if batch and (len(batch) == most or (most_tokens and tokens + n > most_tokens)):
            yield batch
            batch, tokens = [], 0
        batch.append(text)
        tokens += n
    if batch:
        yield batch


class Hashing:
    """Feature hashing of identifier tokens to a unit vector; deterministic, without a network."""

    name = "hashing"

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, texts: list[str], task: str = DOCUMENT) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = np.zeros(self.dim)
        for token in re.findall(IDENTIFIER, text):
            h = int.from_bytes(hashlib.blake2b(token.lower().encode(), digest_size=8).digest(), "little")
            out[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(float(out @ out))
        if norm:
            out /= norm
        else:
            out[0] = 1.0
        return out.tolist()


@dataclass
class Service:
    """A provider behind HTTP: how a batch becomes a request, and a response vectors."""

    name: str
    url: str
    model: str
    dim: int
    request: Callable[[Service, list[str], str], dict]
    response: Callable[[dict], list[list[float]]]
    key: str = ""
    key_header: tuple[str, str] = ("Authorization", "Bearer {}")
    batch: int = 100
    batch_tokens: int = 0
    timeout: float = 60.0
    attempts: int = 3
    requests_per_second: float = 0.0
    tokens_per_minute: float = 0.0
    post: Callable[[str, bytes, dict, float], bytes] | None = None
    buckets: tuple[Bucket, Bucket] | None = field(default=None, init=False, repr=False)

    def embed(self, texts: list[str], task: str = DOCUMENT) -> list[list[float]]:
        if self.buckets is None:  # One pair for all calls of this object, so that successive calls share the rate.
            self.buckets = Bucket(self.requests_per_second, max(1.0, self.requests_per_second)), Bucket(self.tokens_per_minute / 60, max(1.0, self.tokens_per_minute))
        calls, tokens = self.buckets
        headers = {"Content-Type": "application/json"} | ({self.key_header[0]: self.key_header[1].format(self.key)} if self.key else {})
        out: list[list[float]] = []
        for batch in batches_of(texts, self.batch, self.batch_tokens):
            calls.take(1)
            tokens.take(sum(estimate(t) for t in batch))
            body = json.dumps(self.request(self, batch, task)).encode()
            got = self.response(json.loads(with_retries(lambda: (self.post or _post)(self.url, body, headers, self.timeout), self.attempts)))
            out += checked(got, len(batch), self.dim)
        return out


def _post(url: str, body: bytes, headers: dict, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
        return answer.read()


def checked(vectors: list, wanted: int, dim: int) -> list[list[float]]:
    """The first `wanted` vectors, each of dim finite numbers."""
    if len(vectors) < wanted:
        raise EmbeddingError(f"{len(vectors)} vectors for {wanted} texts")
    for v in vectors[:wanted]:
        if v is None or len(v) != dim or not all(isinstance(x, int | float) and math.isfinite(x) for x in v):
            raise EmbeddingError(f"not a vector of {dim} numbers")
    return vectors[:wanted]


def _by_index(answer: dict) -> list[list[float]]:
    rows = {int(r.get("index", k)): r.get("embedding") for k, r in enumerate(answer.get("data") or [])}
    return [rows.get(k) for k in range(max(rows, default=-1) + 1)]


def openai(key: str = "", model: str = "text-embedding-3-small", dim: int = 1536, base: str = "https://api.openai.com/v1", **options) -> Service:
    return Service("openai", f"{base.rstrip('/')}/embeddings", model, dim, lambda s, texts, _: {"model": s.model, "input": texts}, _by_index, key, **options)


def voyageai(key: str, model: str = "voyage-code-3", dim: int = 1024, base: str = "https://api.voyageai.com/v1", **options) -> Service:
    ask = lambda s, texts, task: {"model": s.model, "input": texts, "input_type": task}
    return Service("voyageai", f"{base}/embeddings", model, dim, ask, _by_index, key, **({"batch": 128, "batch_tokens": 100_000} | options))


def ollama(model: str = "nomic-embed-text", dim: int = 768, base: str = "http://localhost:11434", **options) -> Service:
    ask = lambda s, texts, _: {"model": s.model, "prompt": texts[0]}
    return Service("ollama", f"{base}/api/embeddings", model, dim, ask, lambda a: [a.get("embedding")], **({"batch": 1, "timeout": 120.0} | options))


def gemini(key: str, model: str = "gemini-embedding-001", dim: int = 3072, base: str = "https://generativelanguage.googleapis.com/v1beta", **options) -> Service:
    kinds = {DOCUMENT: "RETRIEVAL_DOCUMENT", QUERY: "CODE_RETRIEVAL_QUERY"}

    def ask(s: Service, texts: list[str], task: str) -> dict:
        return {"requests": [{"model": f"models/{s.model}", "content": {"parts": [{"text": t}]}, "taskType": kinds[task]} for t in texts]}

    take = lambda a: [e.get("values") for e in a.get("embeddings") or []]
    limits = {"requests_per_second": 40.0, "tokens_per_minute": 800_000.0}
    return Service("gemini", f"{base}/models/{model}:batchEmbedContents", model, dim, ask, take, key, ("x-goog-api-key", "{}"), **(limits | options))


PROVIDERS = {"openai": openai, "voyageai": voyageai, "ollama": ollama, "gemini": gemini}


def provider(name: str, key: str = "", base: str = "", **options):
    """The provider of a name, an unknown one being a compatible service; a key is needed unless it runs locally or elsewhere."""
    if name == "hashing":
        return Hashing(**options)
    kind = name if name in PROVIDERS else "openai"
    if not key and kind != "ollama" and not base:
        raise ValueError(f"provider {name} needs a key")
    given = ({"key": key} if kind != "ollama" else {}) | ({"base": base} if base else {})
    return PROVIDERS[kind](**given, **options)


def embed_table(rows: DataFrame, model, text: str = "content", task: str = DOCUMENT, at_once: int | None = None) -> DataFrame:
    """rows with vector. at_once: tasks that run together, which share a service's rate; those of the session by default."""
    if at_once is None and isinstance(model, Service):
        at_once = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", vector array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model
        if at_once and isinstance(model, Service):
            own = replace(model, requests_per_second=model.requests_per_second / at_once, tokens_per_minute=model.tokens_per_minute / at_once)
        for frame in frames:
            vectors = own.embed(frame[text].tolist(), task) if len(frame) else []
            yield frame.assign(vector=pd.Series([np.asarray(v, np.float32) for v in vectors], index=frame.index, dtype=object))

    return rows.mapInPandas(run, schema)


def precomputed(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """rows with the vector of an existing table (key, vector)."""
    return rows.join(vectors.select(key, F.col("vector")), key)
