"""Embedders: text to vectors, in the executors."""

from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwright.errors import EmbeddingUnavailable


class Embedder(Protocol):
    """What an embedder is; it must be picklable, and load what it needs when first used."""

    name: str

    def documents(self, texts: Sequence[str]) -> np.ndarray: ...

    def query(self, text: str) -> np.ndarray: ...


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; all-zero rows stay."""
    length = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return (vectors / np.where(length == 0, 1, length)).astype(np.float32)


def shortened(vectors: np.ndarray, dim: int) -> np.ndarray:
    """The first ``dim`` values of each row at length 1."""
    if vectors.shape[-1] < dim:
        raise EmbeddingUnavailable(f"vectors of {vectors.shape[-1]} values can't be cut to {dim}")
    return unit(vectors[..., :dim])


@dataclass(frozen=True)
class HashingEmbedder:
    """Counts of words by the remainder of their CRC: no model, the same everywhere."""

    dim: int = 64

    @property
    def name(self) -> str:
        return f"hash-words:{self.dim}"

    def documents(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            np.add.at(row, [zlib.crc32(w.encode()) % self.dim for w in re.findall(r"\w+", text.lower())], 1)
        return unit(out)

    def query(self, text: str) -> np.ndarray:
        return self.documents([text])[0]


@dataclass(frozen=True)
class HttpEmbedder:
    """An embedding server with ``POST /api/embed`` of a model and a list of texts."""

    model: str
    url: str = "http://localhost:11434"
    dim: int | None = None
    batch: int = 32
    timeout: float = 120.0
    document_prefix: str = ""
    query_prefix: str = ""

    @property
    def name(self) -> str:
        return f"http:{self.model}" + (f"@{self.dim}" if self.dim else "")

    def _post(self, texts: list[str]) -> list[list[float]]:
        request = urllib.request.Request(self.url.rstrip("/") + "/api/embed", json.dumps({"model": self.model, "input": texts}).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                found = json.load(answer)["embeddings"]
        except (OSError, ValueError, KeyError, urllib.error.URLError) as e:
            raise EmbeddingUnavailable(f"the embedding server at {self.url} failed: {e}") from e
        if len(found) != len(texts):
            raise EmbeddingUnavailable(f"{len(texts)} texts were sent and {len(found)} vectors came back")
        return found

    def _embed(self, texts: list[str]) -> np.ndarray:
        rows = [v for n in range(0, len(texts), self.batch) for v in self._post(texts[n : n + self.batch])]
        vectors = np.array(rows, np.float32).reshape(len(rows), -1)
        return shortened(vectors, self.dim) if self.dim else unit(vectors)

    def documents(self, texts: Sequence[str]) -> np.ndarray:
        return self._embed([self.document_prefix + t for t in texts])

    def query(self, text: str) -> np.ndarray:
        return self._embed([self.query_prefix + text])[0]


def resolve(spec: str | None = None) -> Embedder:
    """An embedder by name: ``hash[:dim]`` or ``http:model[@dim]``; from BOOKWRIGHT_EMBEDDER if none is given."""
    spec = spec or os.environ.get("BOOKWRIGHT_EMBEDDER") or "hash"
    kind, _, rest = spec.partition(":")
    if kind == "hash":
        return HashingEmbedder(int(rest or 64))
    if kind == "http" and rest:
        model, _, dim = rest.partition("@")
        return HttpEmbedder(model, os.environ.get("BOOKWRIGHT_EMBED_URL", "http://localhost:11434"), int(dim) if dim else None)
    raise EmbeddingUnavailable(f"unknown embedder {spec!r}; use hash[:dim] or http:model[@dim]")


def embed(rows: DataFrame, embedder: Embedder, text: str, name: str = "embedding") -> DataFrame:
    """``rows`` with ``name``, the vector of column ``text`` (null for null). A failing embedder fails the job."""
    given = rows.drop(name).withColumn("__text", F.col(text))
    schema = T.StructType([*given.drop("__text").schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            at = [n for n, t in enumerate(texts) if t is not None]
            vectors: list[list[float] | None] = [None] * len(texts)
            for n, v in zip(at, embedder.documents([texts[n] for n in at]).tolist() if at else [], strict=True):
                vectors[n] = v
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(vectors, pa.list_(pa.float32()))], names=[f.name for f in schema])

    return given.mapInArrow(run, schema)
