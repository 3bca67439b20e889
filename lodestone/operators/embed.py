"""Embedding texts as unit vectors through a pluggable embedder, in Arrow batches."""

from __future__ import annotations

import contextlib
import hashlib
import re
import threading
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import QUERY_PREFIX
from lodestone.operators.bm25 import TOKENS

BATCH = 64
_FIND = re.compile(TOKENS, re.ASCII).findall

#: Called with the number of texts done and of all texts.
Progress = Callable[[int, int], None]


class Embedder(Protocol):
    """Unit vectors of texts. Questions are marked by a prefix, as models for asymmetric search expect."""

    dims: int
    prefix: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class _Buckets(dict):
    """token -> bucket, found when first asked for."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, token: str) -> int:
        found = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dims
        return found

    def __reduce__(self):
        return _Buckets, (self.dims,)


class HashingEmbedder:
    """A stand-in without a model: token counts hashed into `dims` buckets (first 8 hex digits of MD5), scaled to length 1."""

    prefix = ""

    def __init__(self, dims: int = 64):
        self.dims = dims
        self._known = _Buckets(dims)

    def bucket(self, token: str) -> int:
        return self._known[token]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            if len(self._known) > 200_000:
                self._known.clear()
            found = np.fromiter(map(self._known.__getitem__, _FIND(text or "")), np.int64)
            row += np.bincount(found, minlength=self.dims)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class ModelEmbedder:
    """A sentence-transformers model, loaded once in each Python worker; local files first, then by download."""

    prefix = QUERY_PREFIX
    _loaded: dict[str, object] = {}

    def __init__(self, name: str, dims: int):
        self.name, self.dims = name, dims

    def model(self):
        if self.name not in self._loaded:
            from sentence_transformers import SentenceTransformer

            try:
                self._loaded[self.name] = SentenceTransformer(self.name, local_files_only=True)
            except Exception:  # noqa: BLE001  not cached: try the network
                try:
                    self._loaded[self.name] = SentenceTransformer(self.name)
                except Exception as e:
                    raise RuntimeError(f"cannot load the embedding model {self.name}; download it or check the network") from e
        return self._loaded[self.name]

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model().encode(texts, normalize_embeddings=True, convert_to_numpy=True, show_progress_bar=False))


def embed_texts(embedder: Embedder, texts: list[str], is_query: bool = False, progress: Progress | None = None) -> np.ndarray:
    """Unit vectors of a few texts on the driver, in batches; progress(done, total) after each."""
    texts = [embedder.prefix + t for t in texts] if is_query else texts
    parts = []
    for lo in range(0, len(texts), BATCH):
        parts.append(embedder.encode(texts[lo : lo + BATCH]))
        if progress:
            progress(min(lo + BATCH, len(texts)), len(texts))
    return np.concatenate(parts) if parts else np.zeros((0, embedder.dims))


def embed(embedder: Embedder, text: Column, is_query: bool = False, counter: Accumulator | None = None) -> Column:
    """Unit vectors as array<double>; the embedder is set up once for each worker. counter counts texts as tasks end."""

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            rows = embed_texts(embedder, texts.fillna("").tolist(), is_query)
            if counter is not None:
                counter.add(len(texts))
            yield pd.Series([r.astype(float) for r in rows], index=texts.index)

    return run(text)


@contextlib.contextmanager
def reporting(spark: SparkSession, progress: Progress | None, total: int, every: float = 0.2):
    """A counter for embed() that is reported to progress(done, total) while the block runs, and at its end."""
    if progress is None:
        yield None
        return
    counter, over = spark.sparkContext.accumulator(0), threading.Event()

    def watch():
        seen = 0
        while not over.wait(every):
            if (now := min(counter.value, total)) > seen and now < total:
                seen = now
                progress(now, total)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield counter
    finally:
        over.set()
        thread.join()
    progress(total, total)


def warm_up(*models) -> None:
    """Load the models that load on first use, so that the first request does not wait for them."""
    for m in models:
        load = getattr(m, "model", None)
        if callable(load):
            load()
