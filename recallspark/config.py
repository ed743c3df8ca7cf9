"""Settings with the values the operators take unless told otherwise."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from .errors import ProviderError


@dataclass(frozen=True)
class Settings:
    embedding_model: str = "hash-64"
    vector_multiplier: int = 5
    recent_messages: int = 6
    lexical_messages: int = 3
    semantic_messages: int = 3
    older_messages: int = 6
    summary_trigger: int = 20
    summary_keep: int = 6
    attempts: int = 3
    lexical_backend: str = "bm25"
    fusion_strategy: str = "discounted_agreement"
    provider: str = "offline"

    def __post_init__(self) -> None:
        if not 1 <= self.vector_multiplier <= 10:
            raise ValueError("vector_multiplier must be from 1 to 10")


_current = Settings()


def get() -> Settings:
    return _current


def configure(**changes: object) -> Settings:
    global _current
    _current = replace(_current, **changes)  # type: ignore[arg-type]
    return _current


def reset() -> None:
    global _current
    _current = Settings()


def session(name: str = "recallspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; master and sizes are the cluster's to say."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def require_provider(provider: str, *variables: str) -> None:
    """Stops a run that was configured for another provider, or whose environment lacks what the provider needs, before it calls anything."""
    if _current.provider != provider:
        raise ProviderError(f"configured for {_current.provider}, not for {provider}")
    missing = [v for v in variables if not os.environ.get(v, "").strip()]
    if missing:
        raise ProviderError(f"not set: {', '.join(missing)}")
