"""What can be exchanged: the shapes of parsers, encoders, rerankers, chunkers and rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame


class ShardParser(Protocol):
    """Reads one page range (a row of ``page_ranges``) into blocks; runs in the workers."""

    def __call__(self, row: dict) -> list[dict]: ...


class TextEncoder(Protocol):
    """Vectors of a list of texts; runs in the workers, so it loads its model on first use."""

    def __call__(self, texts: list[str]) -> Sequence[Sequence[float]]: ...


class Reranker(Protocol):
    """Relevance of (query, text) as a column expression."""

    def __call__(self, query: Column, text: Column) -> Column: ...


class Refiner(Protocol):
    """A step of the block sequence: blocks in, blocks of the same columns out."""

    def __call__(self, blocks: DataFrame) -> DataFrame: ...


def choose(kind: str, name: str, known: dict[str, object]) -> object:
    """The entry of that name; an error that lists the known ones for others."""
    if name not in known:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(sorted(known))}")
    return known[name]
