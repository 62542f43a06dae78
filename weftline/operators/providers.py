"""Answering and embedding models behind protocols, with deterministic stand-ins.

No model is reachable offline. The stand-ins make pipelines testable end to
end; they are not the behaviour of any real model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

DIMENSIONS = 64


class Model(Protocol):
    def complete(self, system: str, user: str, max_tokens: int = 2048) -> tuple[str, int, int]:
        """Text, input tokens, output tokens."""


class Echo:
    """Answers with the last line of the prompt."""

    def complete(self, system: str, user: str, max_tokens: int = 2048) -> tuple[str, int, int]:
        last = user.rstrip().rsplit("\n", 1)[-1]
        text = " ".join(last.split()[:max_tokens])
        return text, len(system.split()) + len(user.split()), len(text.split())


def embed(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """Signed counts of hashed words."""
    v = [0.0] * dimensions
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dimensions] += 1.0 if h >> 63 else -1.0
    return v


def with_embeddings(df: DataFrame, text: str, name: str = "embedding") -> DataFrame:
    """``df`` with a vector for each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{name: pdf[text].map(embed)})

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` array<double>"
    return df.mapInPandas(run, schema)


def with_answers(df: DataFrame, system: str, user: str, model: Model, max_tokens: int = 1024) -> DataFrame:
    """``df`` with ``answer, input_tokens, output_tokens`` from a model called on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [model.complete(s, u, max_tokens) for s, u in zip(pdf[system], pdf[user], strict=True)]
            yield pdf.assign(answer=[g[0] for g in got], input_tokens=[g[1] for g in got], output_tokens=[g[2] for g in got])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", answer string, input_tokens bigint, output_tokens bigint"
    return df.mapInPandas(run, schema)
