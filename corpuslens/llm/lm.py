"""Language-model scores by deleted interpolation.

P(w | h) = a * c(h w) / c(h) + b * c(w) / N + (1 - a - b) / (V + 1), over counts of the training documents. The weights depend on
the bucket of c(h) (its power of two). They are learned by expectation-maximisation on deleted counts: each training
document is held out in turn, that is, its own counts are taken away from those it is weighed by. For that, shares c(h w) / c(h) and
c(w) / N are rounded to half powers of two (off by a factor of 2**0.25 = 1.19 at most); scores use the exact ones.

Exact counts of all words and word pairs take part, without a table that has to fit anywhere:

1. Documents are encoded to blocks: distinct word hashes, and each text as numbers into them.
2. Each block asks for the counts of its distinct words and pairs and gives its own: sorted keys, one blob for each key range.
   A word in every document is one entry of a block, so no key is hot. Each range adds up and answers in the same order. There
   are PARTS[1] ranges at most, so the rows of a block are bounded and all of them grow with the input, not with its square; a range
   of more keys than fit in memory is worked off in smaller ranges, which the task deals to a file of its own and back.
3. Blocks meet their answers. A first pass sums up how often which counts occur together (a histogram of fixed size, for the
   driver's EM); a second one scores.

Blocks and answers are written to the shared folder, so a lost executor repeats tasks only.

Null texts count as empty and have the end token only; a null doc_id trains and is scored; rows that repeat count each; columns
beside doc_id and text are ignored; an empty table gives no rows. Words are told apart by 64-bit hashes. A long text is a block of its own.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import arrays
from corpuslens.llm.scratch import Scratch, bounded

#: Text bytes in a block; keys that one range has about, at most, while there are fewer ranges than the most; the least and the most
#: ranges (powers of two); bytes that a task holds before it writes to its file.
BLOCK_BYTES, RANGE_KEYS, PARTS, HELD_BYTES = 6 << 20, 2 << 20, (128, 8192), 32 << 20
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Buckets of c(h): 0 for none, then powers of two. Steps of the histogram: two for each power of two.
BUCKETS, PAIR_STEPS, WORD_STEPS = 24, 64, 96

BLOCK = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary"
ASK = "part int, block long, keys binary, counts binary"
ANSWER = "part int, block long, counts binary, n_words long, n_tokens long"


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


@contextmanager
def single_rows(spark: SparkSession) -> Iterator[None]:
    """Python gets rows one at a time: a block is as large as a batch should be."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def packed(values: np.ndarray, kind: str) -> bytes:
    """Compressed numbers: bytes of equal weight together, which compress better; their length in front."""
    raw = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes, by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)), "<u8")


def unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, "<u8"))


def blocks(docs: DataFrame) -> DataFrame:
    """Encoded documents. A block's tokens are numbers of its sorted distinct word hashes; END closes each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for turn, (batch, data, offsets) in enumerate(arrays.text_slices(batches, "text", BLOCK_BYTES)):
            low = arrays.LOWER[data]
            starts, ends, bounds = arrays.words(low, offsets)
            n = len(batch)
            hashes = np.full(len(starts) + n, END, np.uint64)
            is_word = np.ones(len(hashes), bool)
            is_word[bounds[1:] + np.arange(n)] = False
            hashes[is_word] = arrays.span_hashes(low, starts, ends)
            words, tokens = np.unique(hashes, return_inverse=True)
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task + turn]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[held_out(i) for i in ids]], pa.list_(pa.bool_())),
                    pa.array([(np.diff(bounds) + 1).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([packed_keys(words)], pa.binary()),
                    pa.array([packed(tokens, "<i4")], pa.binary()),
                ],
                names=["block", "doc_ids", "held", "sizes", "words", "tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCK)


class Block:
    """One block, decoded. Keys of words are odd, those of pairs even; ``keys`` has them sorted."""

    def __init__(self, row: dict):
        self.ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        words = unpacked_keys(row["words"])
        self.tokens = unpacked(row["tokens"], "<i4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.first] = len(words)  # the number of BEGIN
        self.before = before
        known = np.append(words, BEGIN)
        pair, self.pair = np.unique(before * (len(words) + 1) + self.tokens, return_inverse=True)
        left, right = known[pair // (len(words) + 1)], words[pair % (len(words) + 1)]
        word_keys = arrays.mix(words * arrays._SEEDS[40]) | np.uint64(1)
        pair_keys = arrays.mix(left * arrays._SEEDS[41] + arrays.mix(right * arrays._SEEDS[42])) & ~np.uint64(1)
        both = np.concatenate([word_keys, pair_keys])
        order = np.argsort(both, kind="stable")
        self.keys, place = both[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word_place, self.pair_place = place[: len(words)], place[len(words) :]
        self.n_words, self.end = len(words), int(np.searchsorted(words, END))

    def counts(self) -> np.ndarray:
        """How often each key occurs in the block's training documents."""
        use = ~self.held[self.doc]
        out = np.zeros(len(self.keys), np.int64)
        out[self.word_place] = np.bincount(self.tokens[use], minlength=self.n_words)
        out[self.pair_place] = np.bincount(self.pair[use], minlength=len(self.pair_place))
        return out

    def answered(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(w), c(h) and c(h w) of each token. Every training document has one END and one BEGIN."""
        of_word = np.append(totals[self.word_place], totals[self.word_place[self.end]])
        return of_word[self.tokens], of_word[self.before], totals[self.pair_place][self.pair]

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As answered, but counted in the token's own document."""

        def times(x: np.ndarray, most: int) -> np.ndarray:
            _, where, n = np.unique(self.doc * most + x, return_inverse=True, return_counts=True)
            return n[where]

        word = times(self.tokens, self.n_words + 1)
        before = np.ones(len(word), np.int64)
        before[1:] = word[:-1]
        before[self.first] = 1
        return word, before, times(self.pair, len(self.pair_place) + 1)


def ask(encoded: DataFrame, parts: int) -> DataFrame:
    shift = np.uint64(64 - (parts.bit_length() - 1))
    edges = np.arange(1, parts, dtype=np.uint64) << shift if parts > 1 else np.empty(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                counts, cut = block.counts(), np.searchsorted(block.keys, edges)
                rows = [(k, c) for k, c in zip(np.split(block.keys, cut), np.split(counts, cut))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(parts), pa.int32()),
                        pa.array([row["block"]] * parts, pa.int64()),
                        pa.array([packed_keys(k) for k, _ in rows], pa.binary()),
                        pa.array([packed(c, "<i4") for _, c in rows], pa.binary()),
                    ],
                    names=["part", "block", "keys", "counts"],
                )

    return encoded.mapInArrow(run, ASK)


class Spill:
    """Records by bucket in one file of a task, which goes with the task."""

    def __init__(self, buckets: int, kind: list[tuple[str, str]]):
        self.file, self.kind, self.bytes = tempfile.TemporaryFile(), np.dtype(kind), 0
        self.held: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.places: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]

    def add(self, bucket: np.ndarray, records: np.ndarray) -> None:
        order = np.argsort(bucket, kind="stable")
        some, first = np.unique(bucket[order], return_index=True)
        for k, own in zip(some.tolist(), np.split(records[order], first[1:])):
            self.held[k].append(own)
        self.bytes += records.nbytes
        if self.bytes > HELD_BYTES:
            for k, own in enumerate(self.held):
                if own:
                    blob = np.concatenate(own).tobytes()
                    self.places[k].append((self.file.seek(0, 2), len(blob)))
                    self.file.write(blob)
                    own.clear()
            self.bytes = 0

    def read(self, bucket: int) -> np.ndarray:
        """The records of a bucket, in the order they came."""
        out = []
        for at, size in self.places[bucket]:
            self.file.seek(at)
            out.append(np.frombuffer(self.file.read(size), self.kind))
        return np.concatenate([*out, *self.held[bucket], np.empty(0, self.kind)])


def answer(asked: DataFrame, parts: int, range_keys: int = RANGE_KEYS, subs: int = 2) -> DataFrame:
    """The totals of each block's keys, in their order; on one row of each range its training words and tokens. A range of more than
    twice ``range_keys`` goes in ``subs`` (a power of two) smaller ones."""

    def row(part: int, block: int, totals: np.ndarray, stats: tuple[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([packed(totals, "<i8")], pa.binary()), pa.array([stats[0]], pa.int64()), pa.array([stats[1]], pa.int64())],
            names=["part", "block", "counts", "n_words", "n_tokens"],
        )

    def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int, int]:
        distinct, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, counts, len(distinct)).astype(np.int64)
        word = (distinct & np.uint64(1)).astype(bool)
        return total[where], int((total[word] > 0).sum()), int(total[word].sum())

    def small(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [unpacked_keys(k) for _, _, k, _ in rows]
        totals, *stats = added(np.concatenate(keys), np.concatenate([unpacked(c, "<i4") for *_, c in rows]))
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        for k, (part, block, _, _) in enumerate(rows):
            yield row(part, block, totals[bounds[k] : bounds[k + 1]], (0, 0) if k else stats)

    def large(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        there = Spill(subs, [("place", "<i8"), ("key", "<u8"), ("count", "<i4")])
        blocks, bounds = [], [0]
        shift, most = np.uint64(64 - (parts.bit_length() - 1) - (subs.bit_length() - 1)), np.uint64(subs - 1)
        for part, block, k, c in rows:
            keys = unpacked_keys(k)
            own = np.empty(len(keys), there.kind)
            own["place"], own["key"], own["count"] = np.arange(bounds[-1], bounds[-1] + len(keys)), keys, unpacked(c, "<i4")
            there.add(((keys >> shift) & most).astype(np.int64), own)
            blocks.append(block)
            bounds.append(bounds[-1] + len(keys))
        edges = np.array(bounds)
        of_block = edges[:-1] // range_keys  # blocks whose totals come back together
        back, n_words, n_tokens = Spill(int(of_block[-1]) + 1, [("place", "<i8"), ("count", "<i8")]), 0, 0
        for s in range(subs):
            own = there.read(s)
            out = np.empty(len(own), back.kind)
            out["place"] = own["place"]
            out["count"], n, t = added(own["key"], own["count"])
            n_words, n_tokens = n_words + n, n_tokens + t
            back.add(of_block[np.searchsorted(edges, own["place"], "right") - 1], out)
        for g in np.unique(of_block).tolist():
            mine, own = np.flatnonzero(of_block == g), back.read(g)
            base = int(edges[mine[0]])
            totals = np.zeros(int(edges[mine[-1] + 1]) - base, np.int64)
            totals[own["place"] - base] = own["count"]
            for k in mine.tolist():
                yield row(part, blocks[k], totals[edges[k] - base : edges[k + 1] - base], (0, 0) if k else (n_words, n_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        for _, own in groupby(every, itemgetter(0)):
            held, size = [], 0
            for r in own:
                held.append(r)
                size += int.from_bytes(r[2][:8], "little") >> 3
                if size > 2 * range_keys:
                    yield from large(chain(held, own))
                    break
            else:
                yield from small(held)

    return asked.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, ANSWER)


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def steps(part: np.ndarray, whole: np.ndarray | float, most: int) -> np.ndarray:
    """Half powers of two of a share; 0 for none."""
    share = np.maximum(part, 0) / np.maximum(whole, 1)
    return np.where(share > 0, np.minimum(np.round(-2 * np.log2(np.maximum(share, 1e-300))).astype(np.int64) + 1, most - 1), 0)


def histogram(block: Block, totals: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of (bucket, pair share, word share) by deleted counts, and how many training tokens fall in each."""
    w, h, hw = (x - y for x, y in zip(block.answered(totals), block.own()))
    left = n - block.sizes[block.doc]
    cell = (bucket(h) * PAIR_STEPS + steps(hw, h, PAIR_STEPS)) * WORD_STEPS + steps(w, left, WORD_STEPS)
    return np.unique(cell[~block.held[block.doc]], return_counts=True)


def learn(cells: np.ndarray, times: np.ndarray, v: int, turns: int = 40) -> np.ndarray:
    """Weights of pair, word and uniform for each bucket, by EM on the histogram."""
    word, pair, b = cells % WORD_STEPS, cells // WORD_STEPS % PAIR_STEPS, cells // (WORD_STEPS * PAIR_STEPS)
    share = lambda s: np.where(s > 0, 2.0 ** (-(s - 1) / 2), 0.0)
    given = np.stack([share(pair), share(word), np.full(len(cells), 1 / (v + 1))], 1)
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    weights[0] = [0, 0.9, 0.1]
    for _ in range(turns):
        part = given * weights[b]
        part *= (times / part.sum(1))[:, None]
        total = np.stack([np.bincount(b, part[:, k], BUCKETS) for k in range(3)], 1)
        seen = total.sum(1) > 0
        weights[seen] = total[seen] / total[seen].sum(1, keepdims=True)
    weights[:, 2] = np.maximum(weights[:, 2], 1e-6)  # so that no text is impossible
    return weights / weights.sum(1, keepdims=True)


def scores(docs: DataFrame, range_keys: int = RANGE_KEYS, some: tuple[int, int] = PARTS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs, spark = bounded(docs), docs.sparkSession
    scratch = Scratch(spark, "lm")
    encoded = scratch.save(blocks(docs), "blocks")
    total = encoded.agg(F.sum(F.aggregate(F.transform("sizes", lambda n: n.cast("long")), F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    parts = min(max(some[0], 1 << int(2 * total / range_keys).bit_length()), some[1])
    subs = max(2, 1 << int(4 * total / parts / range_keys).bit_length())
    with single_rows(spark):
        asked = scratch.save(answer(ask(encoded, parts), parts, range_keys, subs), "answers")
    scratch.release()
    v, n = (int(x or 0) for x in asked.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    answers = asked.select("part", "block", "counts")

    def met(block_rows: pa.Table, answer_rows: pa.Table) -> Iterator[tuple[Block, np.ndarray]]:
        for row in block_rows.to_pylist():
            order = np.argsort(answer_rows.column("part").to_numpy())
            blobs = answer_rows.column("counts").to_pylist()
            yield Block(row), np.concatenate([unpacked(blobs[k], "<i8") for k in order.tolist()])

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        cells, times = zip(*(histogram(b, t, n) for b, t in met(left, right)))
        return pa.table({"cell": pa.array(np.concatenate(cells)), "times": pa.array(np.concatenate(times))})

    pairs = lambda: encoded.groupBy("block").cogroup(answers.groupBy("block"))
    cells = pairs().applyInArrow(weigh, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).orderBy("cell").toArrow()
    weights = learn(cells["cell"].to_numpy(), cells["times"].to_numpy(), v)
    scratch.release()

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, totals in met(left, right):
            w, h, hw = block.answered(totals)
            base = np.log10((w + 1) / (n + v + 1))
            part = weights[bucket(h)]
            p = part[:, 0] * hw / np.maximum(h, 1) + part[:, 1] * w / max(n, 1) + part[:, 2] / (v + 1)
            add = lambda x: np.add.reduceat(x, block.first)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(block.ids, pa.int64()),
                        "held_out": pa.array(block.held),
                        "n_tokens": pa.array(block.sizes),
                        "n_known": pa.array(add((w > 0).astype(np.int64))),
                        "base_score": pa.array(add(base)),
                        "score": pa.array(add(np.log10(p))),
                    }
                )
            )
        return pa.concat_tables(out)

    scored = pairs().applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
