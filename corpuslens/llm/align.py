"""Alignment of two tokenizers' tokens of the same text.

The B tokens of a slice of texts form a static interval index: their byte ranges, sorted and disjoint. Each A token stabs it by
bisection with its first and its last byte, which lists the B tokens that it overlaps. Gaps between B tokens that no A token
spans are the boundaries of groups; in a group, A and B tokens spell the same bytes. Corpus-wide, pairs of ids whose
occurrences end together are counted, which gives a table of translations from one vocabulary to the other.

A is a byte-level BPE ``.json`` and reads a space and the text, B is a sentencepiece ``.model`` that adds the space. Texts are
worked on whole: long ones are given to B's library in parts, cut where no piece of its vocabulary could span the cut.

Null and empty texts, and those whose joined tokens aren't a space and the text (B normalises, or the text holds B's mark for
spaces), have no tokens. A null doc_id stays null; rows that repeat are aligned again and their links count again; columns beside
doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import arrays, bpe
from corpuslens.llm.scratch import Scratch, bounded

#: Characters of a text given to B's library at once, about; links of a block of documents (a long text may have more); links or
#: id pairs in one row at most: Parquet's writer looks at its memory every hundred rows at the soonest.
PART_CHARS, BLOCK_LINKS, ROW_LINKS = 1 << 18, 1 << 20, 1 << 12
ALIGNED = "doc_id long, a_ids binary, b_ids binary, first_b binary, last_b binary, group_a binary, group_b binary, link_a binary, link_b binary"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
BLOCKS = "block long, doc long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, first long, keys array<long>, times array<long>"
B_MARK, CUT = "▁", "\n"

# ---- tokens and their bytes


@lru_cache(4)
def plain_encoder(path: str) -> bpe.Encoder:
    """An encoder to which special strings inside texts are plain text."""
    vocabulary = copy.copy(bpe.vocabulary(path))
    vocabulary.special = {}
    return bpe.Encoder(vocabulary)


class Pieces:
    """A sentencepiece model with the bytes of its pieces, and the pairs of characters that some piece holds side by side."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(B_MARK, " ").encode() for i, p in enumerate(names)]
        whole = [p for i, p in enumerate(names) if not self.model.is_byte(i)]
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.inner = {p[k : k + 2].replace(B_MARK, " ") for p in whole for k in range(len(p) - 1)}
        self.cuttable = not any(CUT in p for p in whole)

    def parts(self, text: str) -> Iterator[str]:
        """A text, or a long one in parts that no piece could join: no piece holds the characters on both sides of a cut."""
        a, n = 0, len(text)
        while self.cuttable and n - a > 2 * PART_CHARS:
            b = next((k for k in range(a + PART_CHARS, n) if text[k - 1 : k + 1].replace(B_MARK, " ") not in self.inner), n)
            yield text[a:b]
            a = b
        if a < n or not n:
            yield text[a:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and for each text (one more) the number of ids before it."""
        todo, owner = [], []
        for k, text in enumerate(texts):
            for j, part in enumerate(self.parts(text)):
                todo.append(CUT + part if j else part)  # so that the space which the model puts first doesn't meet the part
                owner.append(k if not j else -1)
        head, size, ids = self.model.encode(CUT), np.zeros(len(texts), np.int64), []
        at = 0
        for k, own in zip(owner, self.model.encode(todo, num_threads=1) if todo else []):
            at = k if k >= 0 else at
            if k < 0:
                if own[: len(head)] != head:
                    raise ValueError("the model doesn't keep parts of a text apart")
                own = own[len(head) :]
            size[at] += len(own)
            ids.append(np.array(own, "<u4"))
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.concatenate([[0], np.cumsum(size)])


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


# ---- alignment


class IntervalIndex:
    """Disjoint byte ranges in order, none empty; built once, then only asked."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    def stab(self, at: np.ndarray) -> np.ndarray:
        """The range that holds each byte."""
        return np.searchsorted(self.starts, at, "right") - 1

    def overlapped(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last range that each byte range, none empty, overlaps."""
        return self.stab(starts), self.stab(ends - 1)

    def unspanned(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """If no query spans the gap after each range, given the ranges that the queries overlap."""
        n = len(self.starts)
        return np.cumsum(np.bincount(first, minlength=n) - np.bincount(last, minlength=n)) == 0


def _kept(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bounds: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """If the tokens of each text spell its bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])[bounds]
    spelled = memoryview(bpe.spell(pool, starts, lengths, ids))
    return np.array([spelled[ends[k] : ends[k + 1]] == t for k, t in enumerate(texts)], bool)


@dataclass
class Aligned:
    """A slice of texts: ids of both sides, first and last B token that each A token overlaps, tokens of each group, places of linked
    tokens; for each, bounds (one more than texts) of what belongs to a text."""

    doc_ids: pa.Array
    a: np.ndarray
    a_bounds: np.ndarray
    b: np.ndarray
    b_bounds: np.ndarray
    first: np.ndarray
    last: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    group_bounds: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_bounds: np.ndarray


def aligned(batches: Iterator[pa.RecordBatch], own_a: bpe.Encoder, own_b: Pieces) -> Iterator[Aligned]:
    """Slices of record batches of doc_id and text, with their alignment."""
    a_lengths, b_lengths = own_a.vocabulary.lengths, own_b.lengths
    for batch, _, _ in arrays.text_slices(batches, "text", bpe.SLICE_BYTES):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        spaced = [b" " + t.encode() if t else b"" for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in spaced])]).astype(np.int64)
        a, a_bounds = own_a.encode(np.frombuffer(b"".join(spaced), np.uint8), offsets)
        b, b_bounds = own_b.encode(texts)
        good = _kept(own_a.vocabulary.bytes, own_a.vocabulary.starts, a_lengths, a, a_bounds, spaced)
        good &= _kept(own_b.bytes, own_b.starts, b_lengths, b, b_bounds, spaced)
        a, a_bounds = _only(a, a_bounds, good)
        b, b_bounds = _only(b, b_bounds, good)
        a_ends, b_ends = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
        index = IntervalIndex(b_ends - b_lengths[b], b_ends)
        first, last = index.overlapped(a_ends - a_lengths[a], a_ends)
        edge = np.flatnonzero(index.unspanned(first, last))  # the last B token of each group
        a_edge = np.searchsorted(a_ends, b_ends[edge])  # and its last A token
        links = np.flatnonzero(b_ends[last] == a_ends) if len(b) else np.empty(0, np.int64)
        yield Aligned(
            batch.column(0), a, a_bounds, b, b_bounds, first, last, np.diff(a_edge, prepend=-1), np.diff(edge, prepend=-1), np.searchsorted(edge, b_bounds),
            links, last[links], np.searchsorted(links, a_bounds),
        )


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """doc_id, a_ids and b_ids; first_b and last_b: the B tokens that each A token overlaps, by place; group_a and group_b: how many A
    and B tokens each group has; link_a and link_b: places of the A and B tokens that end together. All but doc_id are
    little-endian unsigned 32-bit."""

    def cells(values: np.ndarray, bounds: np.ndarray, less: np.ndarray | None = None) -> pa.Array:
        return pa.array([(values[x:y] - (0 if less is None else less[k])).astype("<u4").tobytes() for k, (x, y) in enumerate(zip(bounds, bounds[1:]))], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in aligned(batches, plain_encoder(tokenizer_a), pieces(tokenizer_b)):
            columns = [
                x.doc_ids, cells(x.a, x.a_bounds), cells(x.b, x.b_bounds), cells(x.first, x.a_bounds, x.b_bounds), cells(x.last, x.a_bounds, x.b_bounds), cells(x.group_a, x.group_bounds),
                cells(x.group_b, x.group_bounds), cells(x.link_a, x.link_bounds, x.a_bounds), cells(x.link_b, x.link_bounds, x.b_bounds),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in ALIGNED.split(", ")])

    return _read(docs).mapInArrow(run, ALIGNED)


def _read(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _only(ids: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts that are good, and their bounds."""
    size = np.diff(bounds)
    return ids[np.repeat(good, size)], np.concatenate([[0], np.cumsum(np.where(good, size, 0))])


# ---- links of the whole corpus


def _spelling(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pool of the numbers below ``size``, each before a comma, then each before a bar, then each before a semicolon."""
    names = [b"%d%s" % (k, end) for end in (b",", b"|", b";") for k in range(size)]
    lengths = np.array([len(x) for x in names], np.int64)
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum(lengths) - lengths, lengths


def spelled(x: Aligned, pool: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
    size, ends_a, ends_b, n = len(pool[1]) // 3, np.cumsum(x.group_a), np.cumsum(x.group_b), len(x.a)
    names = np.concatenate([x.a, x.b]).astype(np.int64)
    names[ends_a - 1] += size
    names[n + ends_b - 1] += 2 * size
    order = np.empty(len(names), np.int64)
    order[np.arange(n) + np.repeat(ends_b - x.group_b, x.group_a)] = np.arange(n)
    order[np.arange(len(x.b)) + np.repeat(ends_a, x.group_b)] = np.arange(n, len(names))
    names = names[order]
    ends = np.concatenate([[0], np.cumsum(pool[2][names])])[x.a_bounds + x.b_bounds]
    every = bpe.spell(*pool, names)
    return [every[i : max(i, j - 1)] for i, j in zip(ends.tolist(), ends[1:].tolist())]


def blocks(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """Documents in blocks of about BLOCK_LINKS links, in rows of two kinds, none with more than ROW_LINKS links or pairs: a document's
    figures and its links, as places among the distinct linked id pairs of its block (more rows with its other links, if there are
    many), and some of these pairs (A's id above B's) with their numbers and the place of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_a, own_b = plain_encoder(tokenizer_a), pieces(tokenizer_b)
        task, count, held = TaskContext.get().partitionId() << 32, 0, 0
        pool = _spelling(max(own_a.vocabulary.size, len(own_b.lengths)))
        docs: list[tuple] = []
        keys: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal docs, keys, held, count
            distinct, at, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            at, ends, rows = at.astype("<u4"), np.cumsum([0, *(d[5] for d in docs)]).tolist(), []
            for k, (d, i, j) in enumerate(zip(docs, ends, ends[1:])):
                rows += [(task + count, k, *d[:5], at[x : min(x + ROW_LINKS, j)].tobytes(), None, None, None) for x in range(i, max(j, i + 1), ROW_LINKS)]
            rows += [(task + count, *[None] * 7, x, distinct[x : x + ROW_LINKS], times[x : x + ROW_LINKS]) for x in range(0, len(distinct), ROW_LINKS)]
            docs, keys, held, count = [], [], 0, count + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

        for x in aligned(batches, own_a, own_b):
            shas = [hashlib.sha256(t).hexdigest() if t else "" for t in spelled(x, pool)]
            docs += zip(x.doc_ids.to_pylist(), *(np.diff(b).tolist() for b in (x.a_bounds, x.b_bounds, x.group_bounds)), shas, np.diff(x.link_bounds).tolist())
            keys.append(x.a[x.link_a].astype(np.int64) << 32 | x.b[x.link_b])
            held += len(x.link_a) + 8 * len(shas)
            if held >= BLOCK_LINKS:
                yield block()
        if docs:
            yield block()

    return _read(docs).mapInArrow(run, BLOCKS)


_TYPE = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
SCHEMA = pa.schema([(n, _TYPE[t]) for n, t in re.findall(r"(\w+) ([^ ,]+)", BLOCKS)])


def translations(pairs: DataFrame) -> DataFrame:
    """key (A's id above B's), count, and best: if it is the highest count of the B id, ties included. ``pairs`` has key and times. What is
    grouped by B id holds each A id once."""
    totals = pairs.groupBy("key").agg(F.sum("times").alias("count"))
    b_id = F.col("key").bitwiseAND(0xFFFFFFFF).alias("b_id")
    highest = totals.groupBy(b_id).agg(F.max("count").alias("highest"))
    return totals.select("*", b_id).join(highest, "b_id").select("key", "count", (F.col("count") == F.col("highest")).alias("best"))


def scores(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Links are counted within blocks of documents first, so that a pair of ids is shuffled once a block that holds it, and a frequent pair
    has as many rows as there are blocks; the counts go back to the blocks in the same way."""
    scratch = Scratch(docs.sparkSession, "align")
    held = scratch.save(blocks(docs, tokenizer_a, tokenizer_b), "blocks")
    pairs = held.filter("keys IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("keys", "times")))
    pairs = pairs.select("block", (F.col("first") + F.col("pos")).alias("pos"), F.col("col.keys").alias("key"), "col.times")
    counted = scratch.save(translations(pairs), "translations")
    answers = pairs.join(counted, "key").select(F.col("block").alias("of"), "pos", "count", "best")

    def run(block: pa.Table, answer: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table([pa.array([], f.type) for f in _SCORED], schema=_SCORED)
        at = answer.column("pos").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = answer.column("count").to_numpy(), answer.column("best").to_numpy()
        links = block.column("links").to_pylist()
        ends = np.cumsum([0, *(len(x) // 4 for x in links)])
        links = np.frombuffer(b"".join(links), "<u4")
        _, first, doc = np.unique(block.column("doc").to_numpy(), return_index=True, return_inverse=True)
        more = {"n_links": np.diff(ends)} | {n: np.diff(np.concatenate([[0], np.cumsum(v[links])])[ends]) for n, v in (("n_best", best), ("count_sum", count))}
        own = {n: block.column(n).take(pa.array(first)) for n in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
        for n, v in more.items():  # of all rows of a document
            own[n] = np.zeros(len(first), np.int64)
            np.add.at(own[n], doc, v)
        return pa.table([own[f.name] for f in _SCORED], schema=_SCORED)

    rows = held.filter("keys IS NULL").drop("first", "keys", "times")
    return rows.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(run, SCORED)


_SCORED = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split(" ") for c in SCORED.split(", "))])
