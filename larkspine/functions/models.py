"""Models behind functions: chat, embedding and vision, with deterministic local stand-ins.

A chat model is a Python function from a list of prompts to a list of answers; it runs over Arrow
batches on the executors, so a remote model is called once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64


class ChatModel(Protocol):
    def __call__(self, prompts: list[str]) -> list[str | None]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def echo_chat(prompts: list[str]) -> list[str | None]:
    """A stand-in: the last line of the prompt."""
    return [p.strip().rsplit("\n", 1)[-1] if p else None for p in prompts]


@lru_cache(1 << 16)
def _component(word: str) -> int:
    """Where a word counts, from ``DIM`` on if it counts as -1."""
    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
    return h % DIM + (0 if h >> 63 else DIM)


def hash_embedder(texts: list[str]) -> list[list[float]]:
    """A stand-in: words hashed to signed components, unit length."""
    at: list[int] = []
    for i, t in enumerate(texts):
        at += [2 * DIM * i + c for c in map(_component, (t or "").lower().split())]
    counts = np.bincount(np.array(at, np.int64), minlength=2 * DIM * len(texts)).reshape(len(texts), 2, DIM)
    v = (counts[:, 0] - counts[:, 1]).astype(float)
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(n == 0, 1, n)).tolist()


def chat(model: Callable[[list[str]], list[str | None]], prompt: Column) -> Column:
    """A model's answers; a batch that fails gives nulls, which parsers turn into their defaults."""

    @F.arrow_udf("string")
    def ask(prompts: pa.Array) -> pa.Array:
        try:
            return pa.array(model(prompts.to_pylist()), pa.string())
        except Exception:  # a model that is down must not fail the job; the answers are missing
            return pa.nulls(len(prompts), pa.string())

    return ask.asNondeterministic()(prompt) if hasattr(ask, "asNondeterministic") else ask(prompt)


#: Texts that one call of an embedder gets.
EMBED_BATCH = 100


def embed(model: Callable[[list[str]], list[list[float]]], text: Column, dim: int | None = None) -> Column:
    """Embeddings of texts.  Where a call fails its texts are tried one by one, and one that fails again is null, or the
    zero vector of ``dim`` components if that is given, so that it fails alone; see failed()."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        every, out = texts.to_pylist(), []
        for at in range(0, len(every), EMBED_BATCH):
            some = every[at : at + EMBED_BATCH]
            try:
                out += model(some)
            except Exception:  # whatever a model raises is that text's failure, not the job's
                out += [_alone(model, t, dim) for t in some]
        return pa.array(out, pa.list_(pa.float32()))

    return run(text)


def _alone(model, text: str | None, dim: int | None) -> list[float] | None:
    try:
        return model([text])[0]
    except Exception:  # as above
        return [0.0] * dim if dim else None


def failed(embedding: Column) -> Column:
    """Whether an embedding is missing or zero, so its row can be reported and retried."""
    return embedding.isNull() | ~F.exists(embedding, lambda x: x != 0)


def describe_image(model: Callable[[list[bytes], list[str]], list[str | None]], image: Column, prompt: Column) -> Column:
    """What a vision model says of images; a call that fails gives nulls."""

    @F.arrow_udf("string")
    def ask(images: pa.Array, prompts: pa.Array) -> pa.Array:
        try:
            return pa.array(model(images.to_pylist(), prompts.to_pylist()), pa.string())
        except Exception:  # a model that is down must not fail the job
            return pa.nulls(len(images), pa.string())

    return ask(image, prompt)


def size_vision(images: list[bytes], prompts: list[str]) -> list[str | None]:
    """A stand-in: the prompt's last line and the image's size."""
    return [None if i is None else f"{(p or '').strip().splitlines()[-1] if (p or '').strip() else ''}: {len(i)} bytes" for i, p in zip(images, prompts)]
