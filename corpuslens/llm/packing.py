"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two: as many of the longest length as
fit, then the binary digits of the rest, longest first. A piece is a sequence of its own, so no sequence
crosses documents, and none needs padding. Pieces of equal length form a bucket, from which batches are drawn.

Null texts count as empty: such a document has only its end id. A null doc_id stays null; rows that repeat are
packed again; columns beside doc_id and text are ignored; an empty table gives no pieces. Nothing is shuffled:
sequence ids come from the place of a piece in its input split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import arrays, bpe
from corpuslens.llm.scratch import bounded

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def decompose(n: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of ``n`` ids; ``longest`` is a power of two."""
    rest = [1 << k for k in range(longest.bit_length() - 2, -1, -1) if (n % longest) >> k & 1]
    lengths = np.array([longest] * (n // longest) + rest, np.int64)
    return np.cumsum(lengths) - lengths, lengths


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit) and bucket
    (log2 of the length), sequence_id and offset. ``tokenizer`` is the path of a byte-level BPE ``.json``."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(tokenizer)
        for batch, data, offsets in arrays.text_slices(batches, "text", bpe.SLICE_BYTES):
            ids, bounds = encoder.encode(data, offsets)
            doc, start, length, total, blob = [], [], [], [], []
            for k in range(len(batch)):
                own = np.append(ids[bounds[k] : bounds[k + 1]], end_id).astype("<u4")
                starts, lengths = decompose(len(own), longest)
                doc += [k] * len(starts)
                start.append(starts)
                length.append(lengths)
                total += [len(own)] * len(starts)
                blob += [own[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(np.concatenate(start)), pa.array(np.concatenate(length)), pa.array(total, pa.int64()), pa.array(blob, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    rows = bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)
    return rows.select(
        "*",
        F.log2(F.col("length").cast("double")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
