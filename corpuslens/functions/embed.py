"""Embeddings of chunks. The built-in embedder hashes words and needs no model; another one is any function from a list of
texts to vectors of one length."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a batch that goes to Python, at most; set in the session where it names none.
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

Embedder = Callable[[list[str]], list[list[float]]]


def hashing(dim: int = 64) -> Embedder:
    """Counts of words in ``dim`` hashed places with hashed signs, of length one. The same text always gives the same vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[8:], "little")
                out[k, h % dim] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def bounded(rows: DataFrame) -> DataFrame:
    """The rows, in a session that bounds the batches which go to Python."""
    if rows.sparkSession.conf.get(BYTES, None) in (None, "-1", str(2**31 - 1), str(2**63 - 1)):
        rows.sparkSession.conf.set(BYTES, str(8 << 20))
    return rows


def embed(chunks: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """chunk_id, workspace_id, document_id, embedding, error of the chunks with text. Where a batch fails, its texts are tried one by
    one; one that fails again has no embedding but the error, and the job goes on."""

    def one_by_one(texts: list[str]) -> Iterator[tuple[np.ndarray | None, str | None]]:
        for text in texts:
            try:
                yield np.asarray(embedder([text])[0], np.float32), None
            except Exception as e:  # noqa: BLE001  an embedder may be remote or out of memory
                yield None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), batch):  # only these texts become Python objects
                part = whole.slice(k, batch)
                texts = part.column("text").to_pylist()
                try:
                    made = [(np.asarray(v, np.float32), None) for v in embedder(texts)]
                except Exception:  # noqa: BLE001
                    made = list(one_by_one(texts))
                columns = [part.column(c) for c in ("chunk_id", "workspace_id", "document_id")]
                columns += [pa.array([v for v, _ in made], pa.list_(pa.float32())), pa.array([e for _, e in made], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "workspace_id", "document_id", "embedding", "error"])

    some = chunks.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("chunk_id", "workspace_id", "document_id", "text")
    return bounded(some).mapInArrow(run, "chunk_id string, workspace_id string, document_id string, embedding array<float>, error string")
