"""Embedding back ends and the choice among them."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.schema import DIMENSION

_FLOATS = T.ArrayType(T.FloatType())


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...

    def dimension(self) -> int: ...


@dataclass
class ZeroEmbedder:
    """All zeros, for indexes that search by keywords only."""

    size: int = DIMENSION

    def embed(self, text: str) -> list[float]:
        return [0.0] * self.size

    def dimension(self) -> int:
        return self.size


@dataclass
class HashEmbedder:
    """A deterministic bag of hashed words of length 1, for tests and machines without a model."""

    size: int = 64

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.size)
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            v[h % self.size] += 1 if h >> 63 else -1
        return (v / (np.linalg.norm(v) + 1e-9)).tolist()

    def dimension(self) -> int:
        return self.size


def pool(hidden: np.ndarray) -> np.ndarray:
    """Mean over the tokens, divided by its length."""
    m = hidden.mean(0)
    return (m / (np.linalg.norm(m) + 1e-9)).astype(np.float32)


class OnnxEmbedder:
    """A local model with inputs ``input_ids, attention_mask, token_type_ids``; a session per process. [] where it can't run."""

    def __init__(self, model: str, vocab: dict[str, int]):
        self.model, self.vocab, self._session = model, vocab, None

    def __getstate__(self):
        return {"model": self.model, "vocab": self.vocab, "_session": None}

    def embed(self, text: str) -> list[float]:
        from tessera.functions.wordpiece import encode

        try:
            if self._session is None:
                import onnxruntime as ort

                o = ort.SessionOptions()
                o.intra_op_num_threads = 1
                self._session = ort.InferenceSession(self.model, o, providers=["CPUExecutionProvider"])
            ids = np.array([encode(text, self.vocab)], dtype=np.int64)
            out = self._session.run(["last_hidden_state"], {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)})
            return pool(out[0][0]).tolist()
        except Exception:
            return []

    def dimension(self) -> int:
        return DIMENSION


def _post(url: str, body: dict, headers: dict) -> dict:
    r = urllib.request.Request(url, json.dumps(body).encode("utf-8", "replace"), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(r, timeout=30) as f:
        return json.load(f)


@dataclass
class RemoteEmbedder:
    """A service that takes {model, prompt} or {model, input} and answers with a vector. ``transport`` can be replaced in tests."""

    model: str
    url: str = "http://localhost:11434/api/embeddings"
    key: str = ""
    field: str = "prompt"
    transport: Callable[[str, dict, dict], dict] = _post
    size: int = 0
    #: Attempts of a request, seconds before the second one (doubled each time), requests that a task has under way.
    tries: int = 3
    wait: float = 0.2
    parallel: int = 8

    def embed(self, text: str) -> list[float]:
        """[] where the service has no answer after all attempts."""
        for k in range(self.tries):
            if k:
                time.sleep(self.wait * 2 ** (k - 1))
            try:
                r = self.transport(self.url, {"model": self.model, self.field: text}, {"Authorization": f"Bearer {self.key}"} if self.key else {})
                v = r["embedding"] if "embedding" in r else r["data"][0]["embedding"]
                self.size = len(v)
                return list(map(float, v))
            except (KeyError, IndexError, TypeError, ValueError):
                return []  # an answer without a vector: asking again changes nothing
            except Exception:
                continue
        return []

    def embed_all(self, texts: list[str]) -> list[list[float]]:
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(self.embed, texts))

    def dimension(self) -> int:
        """Asks the service once if no vector has come yet, so that a stored index is compared with a real size."""
        if not self.size:
            self.embed("dimension")
        return self.size


def openai_embedder(key: str, model: str = "text-embedding-3-small", transport=_post) -> RemoteEmbedder:
    return RemoteEmbedder(model, "https://api.openai.com/v1/embeddings", key, "input", transport)


def zero_vector(size: int = DIMENSION) -> Column:
    """The zero embedder inside the JVM."""
    return F.array_repeat(F.lit(0.0).cast("float"), size)


def embed_column(text: Column, embedder: Embedder) -> Column:
    """array<float> of a text; NULL where the text is NULL or the back end has no answer."""
    if isinstance(embedder, ZeroEmbedder):
        return F.when(text.isNotNull(), zero_vector(embedder.size))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            # each distinct text of a batch once, all of them together where the back end can
            texts = [t for t in s.unique() if t is not None]
            many = getattr(embedder, "embed_all", None)
            done = dict(zip(texts, many(texts) if many else map(embedder.embed, texts)))
            yield pd.Series([done.get(t) or None for t in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, _FLOATS)(text)


def is_reachable(url: str = "http://localhost:11434/api/tags") -> bool:
    try:
        with urllib.request.urlopen(url, timeout=1):
            return True
    except OSError:
        return False


def embedder_of(backend: str, model: str, openai_key: str = "", data_dir: str = ".", env: dict[str, str] | None = None, reachable: Callable[[], bool] = is_reachable) -> Embedder:
    """The back end that a configuration asks for (``choose_backend``); 'hash' is the deterministic one for tests."""
    if backend == "hash":
        return HashEmbedder()
    kind, detail = choose_backend(backend, dict(os.environ) if env is None else env, openai_key, reachable=reachable, data_dir=data_dir)
    if kind == "openai":
        return openai_embedder(detail)
    if kind == "none":
        return ZeroEmbedder()
    if kind == "onnx":
        with open(os.path.join(detail, "vocab.txt"), encoding="utf-8") as f:
            vocab = {w.rstrip("\r\n"): k for k, w in enumerate(f)}
        return OnnxEmbedder(os.path.join(detail, "model.onnx"), vocab)
    return RemoteEmbedder(model)


def choose_backend(backend: str, env: dict[str, str], openai_key: str = "", exists: Callable[[str], bool] = os.path.exists, reachable: Callable[[], bool] = lambda: False, data_dir: str = ".") -> tuple[str, str]:
    """(kind, detail): the back end to use. A key in the environment wins over the configuration's; 'none' is the zero embedder; a local
    model, in the data folder or the current one, is preferred to a service; nothing is ever downloaded."""
    key = env.get("OPENAI_API_KEY") or openai_key
    if backend == "openai" and key:
        return "openai", key
    if backend == "none":
        return "none", ""
    for folder in (data_dir, "."):
        if exists(os.path.join(folder, "model.onnx")) and exists(os.path.join(folder, "vocab.txt")):
            return "onnx", folder
    if backend != "onnx" and reachable():
        return "ollama", ""
    return "ollama", ""
