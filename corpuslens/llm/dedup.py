"""Exact dedup by Grace hash deduplication.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Each task first
groups its own rows in an open-addressing table, so that a text repeated a million times leaves a task as one
record. Records are then dealt by hash to buckets, twice as many as would hold all bytes; a bucket fills a table of bounded
bytes, comparing complete contents. Records that are new once the table is full pass through as spill files (a table in the
shared folder), which the next level deals by another hash to buckets by their own bytes, until every bucket fits. So a level
leaves only what uneven buckets couldn't hold, and the levels hardly grow with the input. A text is in a table or in
spill files, never in both, as a full table still takes in what it holds. Losing an executor repeats tasks only.

Of equal texts the row with the most code points in the original text stays, then the smallest doc_id (null last), then
the one whose original text has the smallest hash, then one of the rows that agree in all three. Null texts count as empty; empty
texts equal each other. Rows that repeat count each. Columns beside doc_id and text, whatever their names, are carried by
``deduplicate`` and otherwise ignored. An empty table gives no rows. A long text is worked on whole (some ten bytes a byte).
Tables compare contents, so hashes only deal; rows find their group again by SHA-256 and 128 bits of BLAKE2b together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import arrays
from corpuslens.llm.scratch import Scratch, bounded, keep_one

#: Bytes of contents that one table holds; two tables at most live in a worker.
TABLE_BYTES = 48 << 20
#: Tasks that a level's buckets are dealt to, at most; each works off its buckets one after the other.
MOST_TASKS = 10_000
SHA_BYTES = 32

RECORD = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("rows", pa.int64()), ("chars", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("n_best", pa.int64())])
RECORD_DDL = "digest binary, content binary, rows long, chars long, keep_id long, keep_row long, n_best long"


def digest_of(content: bytes) -> bytes:
    return hashlib.sha256(content).digest() + hashlib.blake2b(content, digest_size=16).digest()


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes], list[int]]]:
    """Slices with normalised contents of ``text``, their digests and the code points of the originals."""
    for batch, data, offsets in arrays.text_slices(batches, "text"):
        solid = ~arrays.SPACE[data]
        edges, blob = np.concatenate([[0], np.cumsum(arrays.count_between(solid, offsets))]).tolist(), data[solid].tobytes()
        own = [blob[a:b] for a, b in zip(edges, edges[1:])]
        chars = arrays.code_points(data, offsets).tolist()
        yield batch, own, [digest_of(x) for x in own], chars


class Table:
    """An open-addressing table of complete contents with linear probing."""

    def __init__(self, limit: int):
        self.limit, self.bytes, self.entries = limit, 0, []
        self.slots = np.full(1024, -1, np.int32)

    def place(self, digest: bytes, content: bytes) -> tuple[int, int]:
        """The entry that holds the content, or -1, and the slot where the search ended."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (k := int(self.slots[at])) >= 0:
            if self.entries[k][1] == content:
                return k, at
            at = (at + 1) & mask
        return -1, at

    def add(self, digest: bytes, content: bytes, rows: int, chars: int, keep: int | None, row: int, n_best: int) -> bool:
        """False if the content is new and the table is full."""
        k, at = self.place(digest, content)
        if k < 0:
            if self.bytes + len(content) > self.limit and self.entries:
                return False
            self.slots[at] = len(self.entries)
            self.entries.append([digest, content, rows, chars, keep, row, n_best])
            self.bytes += len(content) + 200
            if 2 * len(self.entries) > len(self.slots):
                self._grow()
            return True
        entry = self.entries[k]
        entry[2] += rows
        order = lambda n, i, row: (-n, i is None, i or 0, row)
        mine, other = order(*entry[3:6]), order(chars, keep, row)
        if other < mine:
            entry[3:] = [chars, keep, row, n_best]
        elif other == mine:
            entry[6] += n_best
        return True

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, np.int32)
        mask = len(self.slots) - 1
        for k, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][8:16], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def batches(self, with_content: bool) -> Iterator[pa.RecordBatch]:
        start, size = 0, 0
        for k, entry in enumerate(self.entries):
            size += len(entry[1]) * with_content + 64
            if size > 4 << 20 or k + 1 == len(self.entries):
                yield record_batch(self.entries[start : k + 1], with_content)
                start, size = k + 1, 0


def record_batch(rows: list[list], with_content: bool = True) -> pa.RecordBatch:
    columns = list(zip(*rows))
    if not with_content:
        columns[1] = (None,) * len(rows)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RECORD.types)], schema=RECORD)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def records(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One record per content and task (more if a task's contents exceed a table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(table_bytes)
        for batch, own, digests, chars in contents(batches):
            for i, row, content, digest, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own, digests, chars):
                if not table.add(digest, content, 1, n, i, row, 1):
                    yield from table.batches(True)
                    table = Table(table_bytes)
                    table.add(digest, content, 1, n, i, row, 1)
        yield from table.batches(True)

    return keyed(docs).mapInArrow(run, RECORD_DDL)


def deal(rows: DataFrame, size: int, level: int, table_bytes: int, most_tasks: int) -> DataFrame:
    """Records of ``size`` bytes to buckets, and what their tables hold (without contents) and spill (with contents)."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fan = max(tasks, -(-2 * size // table_bytes))
    many = fan > max(tasks, most_tasks)  # then a task has several buckets, which come sorted
    bucket = F.pmod(F.xxhash64("digest", F.lit(level)), F.lit(fan))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, spilled, size, now = Table(table_bytes), [], 0, None
        for batch in batches:
            for *row, own in zip(*(c.to_pylist() for c in batch.columns)):
                if many and own != now:
                    yield from table.batches(False)
                    table, now = Table(table_bytes), own
                if not table.add(*row):
                    spilled.append(list(row))
                    size += len(row[1])
                    if size > 4 << 20:
                        yield record_batch(spilled)
                        spilled, size = [], 0
        if spilled:
            yield record_batch(spilled)
        yield from table.batches(False)

    dealt = rows.select("*", bucket.alias("bucket")).repartition(max(tasks, most_tasks) if many else fan, "bucket" if many else F.xxhash64("digest", F.lit(level)))
    return (dealt.sortWithinPartitions("bucket") if many else dealt).mapInArrow(fit, RECORD_DDL)


def groups(docs: DataFrame, scratch: Scratch, table_bytes: int = TABLE_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """One row per distinct content: digest, rows, chars, keep_id and keep_row of the best row, n_best rows that equal it."""
    level, rows, done = 0, records(docs, table_bytes), None
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    while True:
        saved = scratch.save(deal(rows, size, level, table_bytes, most_tasks), f"level{level}")
        fitting = saved.filter(F.col("content").isNull()).drop("content")
        done = fitting if done is None else done.unionByName(fitting)
        rows = saved.filter(F.col("content").isNotNull())
        size = rows.agg(F.sum(F.octet_length("content") + F.lit(200))).first()[0]  # null: no rows
        if size is None:
            return done
        level += 1


def judged(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> tuple[DataFrame, Scratch]:
    """doc_id, row, digest of every document, best (if it is like the row of its group that stays), and the columns of groups where
    a group has more than one row."""
    docs, scratch = bounded(docs), Scratch(docs.sparkSession, "dedup")
    many = scratch.save(groups(docs, scratch, table_bytes).filter("rows > 1"), "many")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, digests, _ in contents(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], names=["doc_id", "row", "digest"])

    each = keyed(docs).mapInArrow(run, "doc_id long, row long, digest binary")
    best = F.col("rows").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row")))
    return each.join(many, "digest", "left").withColumn("best", best), scratch


def verdicts(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    joined, scratch = judged(docs, table_bytes)
    if not scratch.read("many").filter("n_best > 1").isEmpty():  # rows that repeat: one of them stays
        joined = scratch.save(joined.withColumn("tag", F.monotonically_increasing_id()), "joined")
        first = joined.filter("best AND n_best > 1").groupBy("digest").agg(F.min("tag").alias("first"))
        joined = joined.join(first, "digest", "left").withColumn("best", F.col("best") & (F.col("first").isNull() | (F.col("tag") == F.col("first"))))
    return joined.select(
        "doc_id",
        F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        F.col("best").alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, SHA_BYTES))).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns. Rows are told apart by doc_id and text."""
    joined, scratch = judged(docs, table_bytes)
    return keep_one(docs, joined.filter("rows IS NOT NULL").select("doc_id", "row", F.col("best").alias("kept"), (F.col("n_best") > 1).alias("twice")), scratch)
