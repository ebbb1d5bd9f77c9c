"""Byte-level BPE encoding with retained offsets, decoding, and token counts by a two-tier lookup.

All of it is map-side. Null texts count as empty and have no ids; a null doc_id stays null; rows that repeat are
encoded again; columns beside doc_id and text are ignored; an empty table gives no rows. Long texts are worked
on whole, one at a time; pre-tokens of any length are merged by a heap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import arrays, bpe
from corpuslens.llm.scratch import bounded

# ---- encoding and decoding


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), piece_bytes and piece_ids: for each pre-token the byte at which it
    starts and the number of ids before it, in the same form. A slice of pre-tokens is decoded by its slice of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary)
        for batch, data, offsets in arrays.text_slices(batches, "text", bpe.SLICE_BYTES):
            ids, bounds, starts, before = encoder.encode_spans(data, offsets)
            first = np.searchsorted(starts, offsets)
            rows = range(len(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([ids[bounds[k] : bounds[k + 1]].tobytes() for k in rows], pa.binary()),
                    pa.array([(starts[first[k] : first[k + 1]] - offsets[k]).astype("<u4").tobytes() for k in rows], pa.binary()),
                    pa.array([(before[first[k] : first[k + 1]] - bounds[k]).astype("<u4").tobytes() for k in rows], pa.binary()),
                ],
                names=["doc_id", "ids", "piece_bytes", "piece_ids"],
            )

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, piece_bytes binary, piece_ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and bytes, from doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.vocabulary(vocabulary)
        for batch in batches:
            for row in range(len(batch)):  # a row at a time bounds the memory
                ids = np.frombuffer(batch.column(1)[row].as_buffer() or b"", "<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([table.decode(ids)], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digest(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, ids_sha256 and decoded_sha256 of encoded rows; the bytes come from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.vocabulary(vocabulary)
        names = [b"%d," % k for k in range(table.size)]
        size = np.array([len(x) for x in names], np.int64)
        start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(names), np.uint8)
        for batch in batches:
            count, listed, decoded = [], [], []
            for blob in batch.column(1):
                ids = np.frombuffer(blob.as_buffer() or b"", "<u4")
                count.append(len(ids))
                listed.append(hashlib.sha256(bpe.spell(pool, start, size, ids)[:-1]).hexdigest())
                decoded.append(hashlib.sha256(table.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), batch.column(2), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "n_pretokens", "ids_sha256", "decoded_sha256"])

    pieces = (F.length("piece_ids") / 4).cast("long").alias("n_pretokens")
    return encoded.select("doc_id", "ids", pieces).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, ids_sha256 string, decoded_sha256 string")


# ---- counts

#: Pre-tokens of at most this many bytes go into the table of frequent ones, as two exact 64-bit words.
PACKED_BYTES = 16
#: Entries of that table, at most.
FREQUENT = 1 << 16


def frequent(encoder: bpe.Encoder) -> tuple[list[bytes], list[int]]:
    """Frequent pre-tokens and their numbers of ids, at most FREQUENT. The vocabulary lists byte strings by how often they were
    met when it was learned, so it names the frequent pre-tokens itself, and no pass over the documents has to count them:
    all its entries that are one pre-token, lowest ids first, and words also with and without the space before them."""
    found: dict[bytes, None] = {}
    table = encoder.vocabulary
    for i in range(table.size):
        piece = table.decode(np.array([i]))
        try:
            word = piece.decode().strip(" ")
        except UnicodeDecodeError:
            continue
        other = (b" " + piece if piece[:1] != b" " else piece[1:]) if word.isalpha() else b""
        found |= dict.fromkeys(x for x in (piece, other) if 0 < len(x) <= PACKED_BYTES and piece not in table.special)
    listed = list(found)
    size = np.array([len(x) for x in listed], np.int64)
    data, offsets = np.frombuffer(b"".join(listed), np.uint8), np.concatenate([[0], np.cumsum(size)])
    one = np.diff(np.searchsorted(bpe.pretokens(data, offsets), offsets)) == 1
    listed = [x for x, good in zip(listed, one.tolist()) if good][:FREQUENT]
    ends = np.cumsum([len(x) for x in listed], dtype=np.int64)
    return listed, encoder.lookup(np.frombuffer(b"".join(listed), np.uint8), np.concatenate([[0], ends[:-1]]), ends)[2].tolist()


class LengthTable:
    """An open-addressing table from packed pre-tokens to their numbers of tokens; it holds complete pre-tokens."""

    def __init__(self, pieces: list[bytes], lengths: list[int]):
        self.mask = max(16, 1 << (2 * len(pieces)).bit_length()) - 1
        self.low, self.high = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.uint64)
        self.length, self.tokens = np.full(self.mask + 1, -1, np.int16), np.zeros(self.mask + 1, np.uint8)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64) if pieces else np.empty(0, np.int64)
        low, high, length = bpe.packed(data, ends - np.array([len(p) for p in pieces], np.int64), ends)
        at = bpe.spread(low, high, length) & np.uint64(self.mask)
        self.probes = 1
        for a, b, n, k, t in zip(low, high, length, at.astype(np.int64).tolist(), lengths):
            probes = 1
            while self.length[k] >= 0:
                k, probes = (k + 1) & self.mask, probes + 1
            self.low[k], self.high[k], self.length[k], self.tokens[k] = a, b, n, t
            self.probes = max(self.probes, probes)

    def find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of tokens; 0 for what isn't there."""
        out = np.zeros(len(low), np.int64)
        at = (bpe.spread(low, high, length) & np.uint64(self.mask)).astype(np.int64)
        left = np.flatnonzero(length <= PACKED_BYTES)
        for _ in range(self.probes):
            k = at[left]
            same = (self.low[k] == low[left]) & (self.high[k] == high[left]) & (self.length[k] == length[left])
            out[left[same]] = self.tokens[k[same]]
            left = left[~same & (self.length[k] >= 0)]
            at[left] = (at[left] + 1) & self.mask
        return out


def count(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens by a tokenizers ``.json`` with byte-level BPE. The frequent pre-tokens' lengths are
    broadcast (FREQUENT entries at most, about 3 MB); others are encoded once per worker and kept in its cache. Nothing is
    shuffled."""
    table = docs.sparkSession.sparkContext.broadcast(LengthTable(*frequent(bpe.Encoder(bpe.vocabulary(tokenizer)))))

    def tally(own: bpe.Encoder, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if bpe.special_cuts(data, offsets, own.vocabulary.special)[1]:
            return np.diff(own.encode(data, offsets)[1])
        starts = bpe.pretokens(data, offsets)
        ends = np.append(starts[1:], len(data))
        found = table.value.find(*bpe.packed(data, starts, ends))
        miss = np.flatnonzero(found == 0)
        found[miss] = own.lookup(data, starts[miss], ends[miss])[2]
        return np.diff(np.concatenate([[0], np.cumsum(found)])[np.searchsorted(starts, offsets)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.encoder(tokenizer)
        for batch, data, offsets in arrays.text_slices(batches, "text"):
            tokens = sum(tally(own, *part[:2]) for part in bpe.parts(data, offsets, own.vocabulary))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens.astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
