"""Seams for what runs outside Spark: PDF and OCR libraries, embedding and language-model services.

An adapter is a picklable object with one method over a batch of plain values; Spark deals the batches, retries tasks
and writes what comes back. Tests and offline runs use HashEmbedder.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION = 1024


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class PageReader(Protocol):
    """Files to pages: (page_number, text, layout_text) of a PDF, or OCR words and boxes of an image."""

    def read(self, content: bytes, file_type: str) -> list[dict]: ...


class ChatModel(Protocol):
    def complete(self, system: str, prompt: str) -> dict: ...


class HashEmbedder:
    """Deterministic unit vectors from hashed words: a stand-in without a model."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for w in text.lower().split():
                d = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[d % self.dimension] += 1.0 if d >> 63 else -1.0
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out


class HttpEmbedder:
    """An OpenAI-style embeddings endpoint; answers are put in input order by their index and must be complete."""

    def __init__(self, url: str, model: str, dimension: int = DIMENSION, key: str = "", timeout: float = 60.0, post: Callable[[str, dict, dict, float], dict] | None = None):
        self.url, self.model, self.dimension, self.key, self.timeout, self.post = url, model, dimension, key, timeout, post

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        said = (self.post or _post)(self.url, {"model": self.model, "input": list(texts)}, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout)
        rows = sorted(said.get("data") or [], key=lambda r: r["index"])
        if len(rows) != len(texts):
            raise ValueError(f"embedding service returned {len(rows)} vectors for {len(texts)} texts")
        return [[float(x) for x in r["embedding"]] for r in rows]


def _post(url: str, body: dict, headers: dict, timeout: float) -> dict:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}), timeout=timeout) as said:
        return json.loads(said.read())


def embed_column(rows: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch: int = 64) -> DataFrame:
    """rows with the embedding of a text column; the service gets ``batch`` texts a call."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found: list = []
            for at in range(0, len(part), batch):
                found += embedder.embed([t or "" for t in part.iloc[at : at + batch]])
            if any(len(v) != embedder.dimension for v in found):
                raise ValueError(f"embeddings must have {embedder.dimension} numbers")
            yield pd.Series(found)

    return rows.withColumn(out, vectors(F.col(text)))


def read_pages(files: DataFrame, reader: PageReader, schema: str) -> DataFrame:
    """One row a page, or word, that the reader finds; a file it can't read gives one row with an error.

    ``schema`` describes the reader's dictionaries; path is put before it and error after.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, kind, content in zip(part["path"], part["file_type"], part["content"], strict=True):
                try:
                    rows, error = reader.read(bytes(content), kind), None
                except Exception as e:  # whatever a foreign library raises belongs to its file
                    rows, error = [{}], f"{type(e).__name__}: {e}"
                yield pd.DataFrame([{"path": path, **{n: r.get(n) for n in names}, "error": error} for r in rows], columns=["path", *names, "error"])

    return files.select("path", "file_type", "content").mapInPandas(run, f"path string, {schema}, error string")


def complete_column(rows: DataFrame, system: str, prompt: str, model: ChatModel) -> DataFrame:
    """rows with answer, prompt_tokens, completion_tokens and status of a model call each."""

    @F.pandas_udf("struct<answer:string,prompt_tokens:int,completion_tokens:int,status:string,error_message:string>")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for p in part:
                try:
                    said = model.complete(system, p)
                    out.append((said.get("answer", ""), said.get("prompt_tokens"), said.get("completion_tokens"), "success", None))
                except Exception as e:  # a failed call is a logged call
                    out.append((None, None, None, "failed", str(e)))
            yield pd.DataFrame(out, columns=["answer", "prompt_tokens", "completion_tokens", "status", "error_message"])

    return rows.withColumn("_call", call(F.col(prompt))).select("*", "_call.*").drop("_call")


def stream_deltas(lines: Sequence[str]) -> list[str]:
    """The text pieces of an event stream: delta or message contents up to [DONE]; broken lines are skipped."""
    out = []
    for line in lines:
        if not line.startswith("data:"):
            continue
        body = line.removeprefix("data:").strip()
        if body == "[DONE]":
            break
        try:
            choice = (json.loads(body).get("choices") or [{}])[0]
        except (json.JSONDecodeError, AttributeError):
            continue
        piece = (choice.get("delta") or {}).get("content") or (choice.get("message") or {}).get("content")
        if piece:
            out.append(piece)
    return out


def data_url(mime: str, content: bytes) -> str:
    return f"data:{mime};base64,{base64.b64encode(content).decode()}"


def runtime_available(*modules: str) -> dict[str, bool]:
    """Which optional libraries this Python has."""
    from importlib.util import find_spec

    return {m: find_spec(m) is not None for m in modules}
