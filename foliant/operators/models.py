"""Adapters for steps that need a model or a reader that isn't part of Spark.

An adapter is any object with the one method its protocol names. It is built once in each Python worker, from the factory
registered under a name, and kept until its time to live is over. Where none is registered, the fallbacks here are used;
they are deterministic and say that they are no models.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Summariser(Protocol):
    def summarise(self, text: str, most: int, least: int) -> str: ...


class EntityFinder(Protocol):
    def entities(self, text: str) -> list[tuple[str, str]]: ...


class Reader(Protocol):
    def read(self, path: str, content: bytes) -> dict[str, Any]: ...


@dataclass(frozen=True)
class ModelConfig:
    factory: Callable[[], Any]
    ttl_seconds: float = 3600.0
    memory_mb: int = 512


_CONFIGS: dict[str, ModelConfig] = {}
_LOADED: dict[str, tuple[float, Any]] = {}


def register_model(name: str, factory: Callable[[], Any], ttl_seconds: float = 3600.0, memory_mb: int = 512) -> None:
    _CONFIGS[name] = ModelConfig(factory, ttl_seconds, memory_mb)
    _LOADED.pop(name, None)


def get_config(name: str, default: Callable[[], Any]) -> ModelConfig:
    return _CONFIGS.get(name, ModelConfig(default))


def load(name: str, config: ModelConfig) -> Any:
    """The adapter of a name in this process, built anew when its time is over."""
    now = time.monotonic()
    held = _LOADED.get(name)
    if held is None or now - held[0] > config.ttl_seconds:
        held = (now, config.factory())
        _LOADED[name] = held
    return held[1]


def usage() -> dict[str, float]:
    """Names loaded in this process, with the seconds since."""
    return {name: time.monotonic() - at for name, (at, _) in _LOADED.items()}


class HashedWords:
    """Normalised hashed counts of words; no model."""

    def __init__(self, width: int = 256):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        from foliant.operators.summaries import bag_of_words

        counts = bag_of_words(texts, self.width)
        norms = np.linalg.norm(counts, axis=1, keepdims=True)
        return (counts / np.where(norms == 0, 1, norms)).tolist()


class LeadSummariser:
    """The beginning of a text, cut at a word; no model."""

    def summarise(self, text: str, most: int = 150, least: int = 37) -> str:
        words = text.split()[:512]
        return " ".join(words[:most])


class NoEntities:
    def entities(self, text: str) -> list[tuple[str, str]]:
        return []


def embed(docs: DataFrame, text_col: str = "text", out: str = "embedding", model: str = "embedder") -> DataFrame:
    """``docs`` with a vector of each text."""
    config = get_config(model, HashedWords)

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        found = load(model, config).embed([t or "" for t in texts.to_pylist()])
        return pa.array(found, pa.list_(pa.float32()))

    return docs.withColumn(out, vectors(text_col))


def summarise(docs: DataFrame, most: int = 150, text_col: str = "text", out: str = "summary", model: str = "summariser") -> DataFrame:
    """``docs`` with an abstractive summary of ``most`` words."""
    config = get_config(model, LeadSummariser)

    @F.arrow_udf("string")
    def made(texts: pa.Array) -> pa.Array:
        adapter = load(model, config)
        return pa.array([None if t is None else adapter.summarise(t, most, most // 4) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(out, made(text_col))


def find_entities(docs: DataFrame, text_col: str = "text", out: str = "entities", model: str = "entities") -> DataFrame:
    """``docs`` with an array of (label, text) that a model finds."""
    config = get_config(model, NoEntities)
    kind = pa.list_(pa.struct([("label", pa.string()), ("text", pa.string())]))

    @F.arrow_udf("array<struct<label: string, text: string>>")
    def found(texts: pa.Array) -> pa.Array:
        adapter = load(model, config)
        rows = [[{"label": a, "text": b} for a, b in adapter.entities(t or "")] for t in texts.to_pylist()]
        return pa.array(rows, kind)

    return docs.withColumn(out, found(text_col))


def run_each(files: DataFrame, function: Callable[[str, bytes], str], path_col: str = "path", content_col: str = "content") -> DataFrame:
    """A user's function over files, with errors kept to their row and the time each took."""
    schema = "path string, success boolean, result string, error string, processing_time double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                began = time.perf_counter()
                out = {"path": row["path"], "success": True, "result": None, "error": None}
                try:
                    out["result"] = function(row["path"], row["content"])
                except Exception as e:  # one file's failure is that file's result
                    out |= {"success": False, "error": str(e)}
                rows.append(out | {"processing_time": time.perf_counter() - began})
            kinds = [("path", pa.string()), ("success", pa.bool_()), ("result", pa.string()), ("error", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*kinds, ("processing_time", pa.float64())]))

    held = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    return held.mapInArrow(run, schema)
