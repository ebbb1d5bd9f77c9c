"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (3 to 5 bytes of ``<word>``, and the whole), hashed into a
fixed number of buckets; a document is the mean of its words; a linear softmax reads it. As all of that is linear up
to the softmax, scoring needs one number per bucket. A misspelling that was never seen shares most n-grams with
the word it stands for, and so its vector.

Training reads a bounded, documented sample of the labelled rows (TRAIN_ROWS: the lowest hashes of doc_id in each class),
whole texts as bags of their words (of TRAIN_WORDS distinct ones at most); scoring reads every whole text, map-side, without a shuffle. Null texts count as empty; texts without a
word get the score of the bias; a null doc_id is scored and never held out or trained on; null labels are left out; of
several labels of a doc_id the highest counts; rows that repeat are scored each; other columns are ignored; without
labels of both classes every score is the share of toxic labels (0.0 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import arrays
from corpuslens.llm.scratch import bounded

#: Labelled rows to train on, at most, of the toxic and of the other class.
TRAIN_ROWS = (1500, 3500)
#: N-grams that a smaller share of the training texts hold, or only one, have no vector of their own (that of nothing, zero).
MIN_SHARE = 0.004
#: Distinct words of a text that training takes, at most (those of the lowest hashes); a text is scored by all of its words.
TRAIN_WORDS = 4096
#: RATE falls over the last SETTLE of the epochs, as the last steps else may miss by far.
BUCKET_BITS, DIM, EPOCHS, RATE, SETTLE, DECAY = 20, 4, 80, 0.3, 0.3, 1e-6
SIZES = (3, 4, 5)
PART_WORDS, PART_VALUES = 8_000, 200_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LETTER[[ord("'"), ord("@"), ord("$")]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of runs of letters and digits, and their number before each row (one more)."""
    low = arrays.LOWER[data]
    starts, ends = arrays.spans(_LETTER, low, offsets)
    return low, starts, ends, np.searchsorted(starts, offsets)


def ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of byte ranges, and for each range (one more) the number of n-grams before it."""
    size = ends - starts + 2
    edge = np.concatenate([[0], np.cumsum(size)])
    padded = np.empty(int(edge[-1]), np.uint8)
    padded[edge[:-1]], padded[edge[1:] - 1] = ord("<"), ord(">")
    inner = np.ones(len(padded), bool)
    inner[edge[:-1]] = inner[edge[1:] - 1] = False
    n = size - 2
    padded[inner] = data[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    value = arrays._BYTE[padded]
    owner = np.repeat(np.arange(len(size)), size)
    buckets, owners = [arrays.span_hashes(padded, edge[:-1], edge[1:])], [np.arange(len(size))]
    for k in SIZES:
        if len(padded) < k:
            continue
        h = np.zeros(len(padded) - k + 1, np.uint64)
        for j in range(k):
            h += value[j : len(padded) - k + 1 + j] * arrays._SEEDS[j + 8 * (k - 2)]
        fits = owner[: len(h)] == owner[k - 1 :]
        buckets.append(arrays.mix(h[fits]))
        owners.append(owner[: len(h)][fits])
    bucket, by = np.concatenate(buckets), np.concatenate(owners)
    sort = np.argsort(by, kind="stable")
    return (bucket[sort] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.searchsorted(by[sort], np.arange(len(size) + 1))


def unique_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and which of them each word is."""
    _, first, where = np.unique(arrays.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    return first, where


def run_sums(values: np.ndarray, index: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of the values at runs of an index, a bounded part at a time."""
    out, k = np.empty((len(edge), values.shape[1]), values.dtype), 0
    while k < len(edge):
        j = max(k + 1, int(np.searchsorted(edge, edge[k] + PART_VALUES)))
        a, b = edge[k], edge[j] if j < len(edge) else len(index)
        out[k:j] = np.add.reduceat(values[index[a:b]], edge[k:j] - a)
        k = j
    return out


@dataclass
class Model:
    """log-odds of a text: bias + mean over words of the mean over n-grams of ``value``."""

    value: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        low, starts, ends, bounds = tokens(data, offsets)
        n = np.diff(bounds)
        logit = np.full(len(n), self.bias)
        if len(starts):
            first, where = unique_words(low, starts, ends)
            bucket, edge = ngrams(low, starts[first], ends[first])
            word = np.add.reduceat(self.value[bucket], edge[:-1]) / np.diff(edge)
            total = np.concatenate([[0], np.cumsum(word[where])])
            logit += np.diff(total[bounds]) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


@dataclass
class Bags:
    """Distinct words of texts (bytes of the words one after the other, and where each ends), how often a text says each, ends of the
    texts among them, and the words of each text in all."""

    data: np.ndarray
    ends: np.ndarray
    times: np.ndarray
    bounds: np.ndarray
    total: np.ndarray


def bags(data: np.ndarray, offsets: np.ndarray, most: int = TRAIN_WORDS) -> Bags:
    low, starts, ends, bounds = tokens(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    hashes = arrays.span_hashes(low, starts, ends)
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    at = np.flatnonzero(new)
    times, of, first = np.diff(at, append=len(order)), row[order][at], order[at]
    few = np.arange(len(of)) - np.searchsorted(of, of) < most  # in a row they stand by their hashes
    times, of, first = times[few], of[few], first[few]
    size = ends[first] - starts[first]
    flat = low[np.repeat(starts[first] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return Bags(flat, np.cumsum(size), times, np.searchsorted(of, np.arange(len(offsets))), np.diff(bounds))


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """A model of texts in memory."""
    return train_bags(bags(*arrays.buffers(pa.array(texts, pa.string()))), toxic, weight, seed)


def train_bags(bag: Bags, toxic: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Embeddings and softmax by Adam on the weighted cross-entropy, over all texts in each epoch."""
    total, n_texts = float(weight.sum()) if len(weight) else 0.0, len(bag.total)
    share = float((weight * toxic).sum()) / total if total else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 700.0 if share else -700.0)
    low, ends = bag.data, bag.ends
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first, word = unique_words(low, starts, ends)
    # documents by distinct words, each with its share
    row = np.repeat(np.arange(n_texts), np.diff(bag.bounds))
    part = (bag.times / bag.total[row]).astype(np.float32)
    starts, ends = starts[first], ends[first]
    by_word = np.argsort(word, kind="stable").astype(np.int32)
    word_edge = np.searchsorted(word[by_word], np.arange(len(first)))
    row_edge = bag.bounds
    busy = np.flatnonzero(np.diff(row_edge))
    # n-grams in parts, twice: those that enough texts hold are known only after all are counted
    texts_of = np.bincount(word, minlength=len(first))
    held, size = np.zeros(1 << BUCKET_BITS), np.empty(len(first), np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for count in (True, False):
        for k in range(0, len(first), PART_WORDS):
            part_of = slice(k, min(k + PART_WORDS, len(first)))
            bucket, edge = ngrams(low, starts[part_of], ends[part_of])
            size[k : k + PART_WORDS] = np.diff(edge)
            owner = np.repeat(np.arange(part_of.start, part_of.stop, dtype=np.int32), np.diff(edge))
            if count:
                held += np.bincount(bucket, texts_of[owner], 1 << BUCKET_BITS)
            else:
                common = held[bucket] >= max(2, round(MIN_SHARE * n_texts))
                kept.append((bucket[common].astype(np.int32), owner[common]))
    scale = (1 / size).astype(np.float32)[:, None]
    bucket, ngram_word = (np.concatenate([x[i] for x in kept]) for i in (0, 1))
    kept.clear()
    if not len(bucket):
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(share / (1 - share))))
    spelled, edge = np.unique(ngram_word, return_index=True)  # the words with a vector
    by_bucket = np.argsort(bucket, kind="stable").astype(np.int32)
    used, used_edge = np.unique(bucket[by_bucket], return_index=True)

    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (DIM, 2)), np.log([1 - share, share])
    compact = np.searchsorted(used, bucket).astype(np.int32)
    bucket_word = ngram_word[by_bucket]
    del bucket, ngram_word, by_bucket, low
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (embedding, softmax, bias)]
    target, w = np.eye(2)[toxic.astype(int)], (weight / total)[:, None]
    for epoch in range(1, EPOCHS + 1):
        words = np.zeros((len(first), DIM), np.float32)
        words[spelled] = run_sums(embedding, compact, edge) * scale[spelled]
        docs = np.zeros((n_texts, DIM))
        docs[busy] = np.add.reduceat(words[word] * part[:, None], row_edge[:-1][busy])
        logit = docs @ softmax + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - target) * w
        back = (error @ softmax.T).astype(np.float32)
        per_word = np.add.reduceat((back[row] * part[:, None])[by_word], word_edge) * scale
        slope = run_sums(per_word, bucket_word, used_edge) + DECAY * embedding
        for q, g, (m, v) in zip((embedding, softmax, bias), (slope, docs.T @ error, error.sum(0)), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            rate = (RATE if q is not bias else 0.05) * min(1, (EPOCHS + 1 - epoch) / (SETTLE * EPOCHS))
            q -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-12)
    value = np.zeros(1 << BUCKET_BITS, np.float32)
    value[used] = embedding @ (softmax[:, 1] - softmax[:, 0])
    return Model(value, float(bias[1] - bias[0]))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = TRAIN_ROWS) -> Model:
    """A model of the labelled rows that aren't held out: all of them, or of each class as many as ``rows`` says, with the lowest hashes."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.filter("toxic = 1").orderBy(*order).limit(rows[0]).unionByName(known.filter("toxic = 0").orderBy(*order).limit(rows[1]))
    drawn = {t: min(n, rows[1 - t]) for t, n in counts.items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.text_slices(batches, "text"):
            bag, n = bags(data, offsets), len(batch)
            edge = np.concatenate([[0], bag.ends])[bag.bounds]
            spelled = [bag.data[a:b].tobytes() for a, b in zip(edge, edge[1:])]
            size = np.diff(bag.ends, prepend=0)
            lists = [[x[bag.bounds[k] : bag.bounds[k + 1]].astype("<i4").tobytes() for k in range(n)] for x in (size, bag.times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in (spelled, *lists)), pa.array(bag.total.astype(np.int64)), batch.column(2)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        got = pa.Table.from_batches(held).sort_by([(n, "ascending") for n in names])
        ids = got.column("doc_id").to_numpy()
        got = got.take(np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if len(ids) else 0)))  # one text of a doc_id
        spelled, size, times = (np.frombuffer(b"".join(got.column(n).to_pylist()), kind) for n, kind in (("spelled", np.uint8), ("size", "<i4"), ("times", "<i4")))
        of = np.array([len(x.as_buffer() or b"") // 4 for x in got.column("size")], np.int64)
        bag = Bags(spelled, np.cumsum(size, dtype=np.int64), times, np.concatenate([[0], np.cumsum(of)]), got.column("total").to_numpy())
        toxic = got.column("toxic").to_numpy().astype(np.int64)
        weight = np.array([counts[t] / drawn[t] for t in toxic.tolist()])
        del got, held
        arrays.give_back()
        model = train_bags(bag, toxic, weight)
        yield pa.RecordBatch.from_arrays([pa.array([model.value.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], names=["value", "bias"])

    # texts become bags of words where they are read; one task of an executor trains on at most sum(rows) of them, and only the model
    # comes to the driver
    names = ["doc_id", "spelled", "size", "times", "total", "toxic"]
    got = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    got = got.mapInArrow(gather, "doc_id long, spelled binary, size binary, times binary, total long, toxic int")
    made = got.repartition(1).mapInArrow(run, "value binary, bias double").first()
    return Model(np.frombuffer(bytes(made.value), "<f4"), made.bias) if made else train([], np.empty(0, np.int64), np.empty(0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(data, offsets))], names=["doc_id", "score"])

    scored = bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            data, offsets = arrays.buffers(pa.array(texts, pa.string(), from_pandas=True))
            yield pd.Series(np.concatenate([shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in arrays.slices(offsets)] or [np.empty(0)]))
            del texts, data, offsets
            arrays.give_back()

    return docs.filter(F.pandas_udf(probability, "double")("text") < 0.5)
