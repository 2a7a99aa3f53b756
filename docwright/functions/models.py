"""Plug-in boundaries for models, with deterministic offline stand-ins.

The stand-ins make pipelines run and be tested without a network. They are no substitutes for trained models and their
scores mean nothing beyond the tests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], list[float]]
Generator = Callable[[list[str]], list[str]]


def hashed_embedder(dim: int = 384) -> Embedder:
    """Stand-in: signed feature hashing of words, unit length; a blank text is the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


_MADE: dict = {}


def once(factory: Callable[[], object]) -> object:
    """What a factory makes, made once in a Python worker however many batches and queries it serves."""
    key = getattr(factory, "__module__", ""), getattr(factory, "__qualname__", repr(factory)), getattr(factory, "__defaults__", None)
    if key not in _MADE:
        _MADE[key] = factory()
    return _MADE[key]


def embed(text: Column, factory: Callable[[], Embedder] = hashed_embedder) -> Column:
    """A column of vectors, an Arrow batch at a time; a null text is embedded as ''."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once(factory)
        for b in batches:
            yield pd.Series(list(model(b.fillna("").tolist())))

    return run(text)


def scored(question: Column, content: Column, factory: Callable[[], Scorer]) -> Column:
    """A cross-encoder's scores of (question, content) rows, by a plug-in; nulls count as ''."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = once(factory)
        for q, c in batches:
            yield pd.Series(model(q.fillna("").tolist(), c.fillna("").tolist()), dtype="float64")

    return run(question, content)


def generated(prompt: Column, factory: Callable[[], Generator]) -> Column:
    """A generator's (or judge's) replies to prompts, by a plug-in; a null prompt has none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once(factory)
        for b in batches:
            some = b.notna()
            out = pd.Series([None] * len(b), index=b.index, dtype=object)
            if some.any():
                out[some] = model(b[some].tolist())
            yield out

    return run(prompt)


def lexical_score(question: Column, content: Column) -> Column:
    """Stand-in for a cross-encoder: the share of the question's words that the content has."""
    from .text import tokens

    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(content))) / F.size(q))


def first_chunk_answer(chunks: Column) -> Column:
    """Stand-in for a generator: the best chunk's first sentence."""
    from .text import sentences

    return F.element_at(sentences(F.element_at(chunks, 1)), 1)
