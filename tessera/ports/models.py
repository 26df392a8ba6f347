"""Embedding and language-model ports with deterministic offline stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def complete(self, messages: Sequence[dict]) -> str: ...
    def submit(self, messages: Sequence[dict], call: dict) -> str | None: ...


class HashEmbedder:
    """Words hashed into a unit vector: equal texts are equal, shared words bring them near."""

    def __init__(self, width: int = 384):
        self.width = width

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.width)
            for w in text.casefold().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.width] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class ScriptedModel:
    """Answers from a function; counts its calls."""

    def __init__(self, answer: Callable[[Sequence[dict]], str]):
        self.answer, self.calls = answer, 0

    def complete(self, messages: Sequence[dict]) -> str:
        self.calls += 1
        return self.answer(messages).strip()

    def submit(self, messages: Sequence[dict], call: dict) -> str | None:
        self.calls += 1
        return self.answer(messages)


#: Texts that are Python strings, and vectors that are Python numbers, at a time.
EMBEDDED = 256


def _vectors(texts: pa.Array, embedder: Embedder) -> pa.Array:
    """A vector for each text, null for a null one; a slice at a time, kept as plain doubles."""
    parts = []
    for at in range(0, len(texts), EMBEDDED):
        part = texts.slice(at, EMBEDDED)
        known = part.is_valid().to_numpy(zero_copy_only=False)
        vectors = [np.asarray(v, dtype=np.float64) for v in embedder.embed(part.drop_null().to_pylist())] if known.any() else []
        if len(vectors) != known.sum():
            raise ValueError(f"{known.sum()} texts, {len(vectors)} vectors")
        sizes = np.zeros(len(part), dtype=np.int32)
        sizes[known] = [len(v) for v in vectors]
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.append(~known, False))  # a null offset: a null list
        parts.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0), *vectors]))))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))


def embed_column(text: Column, make: Callable[[], Embedder] = HashEmbedder) -> Column:
    """Embed a column slice by slice; a worker makes its embedder once, a null text has no vector."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = make()
        for texts in batches:
            yield _vectors(texts, embedder)

    return run(text)


def with_system(system: str, conversation: Sequence[dict]) -> list[dict]:
    return [{"role": "system", "content": system}, *conversation]
