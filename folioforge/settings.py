"""Settings with defaults, read from the session's configuration or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    chunker: str = "section"
    pages_per_shard: int = 50
    max_file_bytes: int = 200 * 1024 * 1024
    embed_batch: int = 32
    embed_pause: float = 2.0
    embed_retries: int = 6
    prefetch: int = 30
    candidates: int = 30
    top_n: int = 10
    repeated_ratio: float = 0.6
    cover_page: int = 1
    index_buckets: int = 64

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, int | float) and f.name != "embed_pause" and value <= 0:
                raise ValueError(f"{f.name} must be above 0, not {value}")


def load_settings(spark: SparkSession | None = None) -> Settings:
    """folioforge.<name> of the session, else FOLIOFORGE_<NAME> of the environment, else the default."""
    given = {}
    for f in fields(Settings):
        raw = spark.conf.get(f"folioforge.{f.name}", None) if spark else None
        raw = raw if raw is not None else os.environ.get(f"FOLIOFORGE_{f.name.upper()}")
        if raw is not None:
            given[f.name] = type(f.default)(raw)
    return Settings(**given)
