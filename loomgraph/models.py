"""The hooks for models: anything that fits these protocols can take the place of the offline defaults."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame


class Embedder(Protocol):
    """Texts to vectors; see operators.vectors.embed."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    """Queries and texts, pair by pair, to scores; default operators.vectors.word_maxsim."""

    def __call__(self, queries: list[str], texts: list[str]) -> list[float | None]: ...


class Model(Protocol):
    """Prompts to answers; see operators.batchio.cached_calls."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class Extractor(Protocol):
    """chunks(chunk_id, content) to mentions(chunk_id, pos, name); default operators.extract.regex_entities."""

    def __call__(self, chunks: DataFrame, key: str, text: str) -> DataFrame: ...


class Reporter(Protocol):
    """members, nodes, edges to reports; default operators.community.extractive_reports."""

    def __call__(self, members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame: ...
