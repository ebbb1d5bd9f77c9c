"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space between words ignored) and hashed. For each host (the source of a
document) the distinct documents that hold a line are counted; lines above the host's limit are removed (``clean`` takes them
out of the texts), and a document that this depletes is rejected. Documents of the same lines count once, so a group of copies
doesn't turn its own text into boilerplate; every other document counts, near copies too.

Null texts have no words; null hosts are a host of their own; a null doc_id stays null; rows that repeat are judged
each (and alike, as copies); other columns, whatever their names, are carried by ``clean`` and otherwise ignored; an empty
table gives no rows. Texts are worked on whole; what takes memory is some hundred bytes a word. Lines are told apart by 64-bit hashes.
Lines go through one shuffle with counts combined map-side; lines that reach the limit are joined back, and hot ones
of these are split by adaptive execution.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import arrays
from corpuslens.llm.scratch import Scratch, bounded

#: A line is removed in a host where more distinct documents hold it than SHARE of the host's distinct documents, and than
#: MIN_DOCS, which only keeps a few documents from deciding in a small host.
MIN_DOCS, SHARE = 5, 0.02
#: A document is depleted if removing lines leaves fewer words than LEFT_WORDS, or less than LEFT_SHARE of its words.
LEFT_WORDS, LEFT_SHARE = 10, 0.2
#: Lines to remove that tasks carry (8 bytes each), at most.
CARRIED = 1 << 20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

FEATURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>, signature long, row long"
LINE = pa.struct([("line", pa.int64()), ("words", pa.int32())])


def in_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows too."""
    return arrays.mix(hashes + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> np.ndarray:
    """For each row, the words in windows that occur twice or more in it."""
    found, first = arrays.windows(hashes, bounds, size)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    _, where, times = np.unique(in_row(found, row), return_inverse=True, return_counts=True)
    at = (np.arange(len(found)) - first[row] + bounds[row])[times[where] > 1]
    cover = np.bincount(at, minlength=len(hashes) + size + 1) - np.bincount(at + size, minlength=len(hashes) + size + 1)
    return arrays.count_between(np.cumsum(cover)[: len(hashes)] > 0, bounds)


def text_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows, hashes and numbers of words of all lines with a word. A normalised line is the sequence of its words."""
    low = arrays.LOWER[data]
    starts, ends, _ = arrays.words(low, offsets)
    a, b = arrays.spans(arrays.IN_LINE, data, offsets)
    first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
    a, b, first, last = (x[last > first] for x in (a, b, first, last))
    line = arrays.sequence_hashes(arrays.span_hashes(low, starts, ends), first, last)
    return a, b, np.searchsorted(offsets, a, "right") - 1, line, last - first


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """The base figures of each document and its distinct normalised lines (hash, words), a signature of all of them, and ``row``, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.text_slices(batches, "text"):
            n = len(batch)
            starts, ends, bounds = arrays.words(data, offsets)
            a, b, row, line, size = text_lines(data, offsets)
            of_row = np.bincount(row, minlength=n)
            _, once = np.unique(in_row(arrays.span_hashes(data, a, b), row), return_index=True)
            distinct = np.bincount(row[once], minlength=n)
            _, once, where = np.unique(in_row(line, row), return_index=True, return_inverse=True)
            size = np.bincount(where, size, len(once)).astype(np.int32)
            line = line.view(np.int64)
            sort = np.lexsort((line[once], row[once]))
            line, size, row = line[once][sort], size[sort], row[once][sort]
            edge = np.searchsorted(row, np.arange(n + 1))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(line.view(np.uint64)))])
            signature = (total[edge[1:]] - total[edge[:-1]]).view(np.int64)
            lines = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(line), pa.array(size)], fields=list(LINE)))
            figures = (
                np.diff(bounds),
                arrays.count_between(~arrays.SPACE[data] & ((data & 0xC0) != 0x80), offsets),
                arrays.count_between(SYMBOLS[data], offsets),
                of_row - distinct,
                repeated_words(arrays.span_hashes(data, starts, ends), bounds),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x.astype(np.int64)) for x in figures), lines, pa.array(signature), batch.column(2)],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "signature", "row"],
            )

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, FEATURES)


def counted(docs: DataFrame, host: str, min_docs: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The features of each document with a uid; the frequent lines that each holds (host, line, uid, words); and the lines above their host's limit (host, line)."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(features(docs, host).withColumn("uid", F.monotonically_increasing_id()), "features")
    own = rows.select("uid", F.coalesce("host", F.lit("\0")).alias("host"), "signature", F.explode("lines").alias("l")).select("uid", "host", "signature", "l.*")
    hosts = rows.groupBy(F.coalesce("host", F.lit("\0")).alias("host"), "signature").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("docs"))
    limit = F.greatest(F.lit(float(min_docs)), F.lit(share) * F.col("docs"))
    often = own.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    often = scratch.save(often.join(hosts, "host").filter(F.col("n") > limit).select("host", "line", limit.alias("limit")), "often")
    hits = scratch.save(own.join(often, ["host", "line"]), "hits")
    gone = hits.groupBy("host", "line", "limit").agg(F.countDistinct("signature").alias("n"))
    gone = scratch.save(gone.filter(F.col("n") > F.col("limit")).select("host", "line"), "gone")
    return rows, hits, gone


def judged(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, host, row, the base figures, base_failed, removed_words, kept, its signature, and the hashes of its removed lines."""
    rows, hits, gone = counted(docs, host, min_docs, share)
    return _verdicts(rows, hits, gone)


def _verdicts(rows: DataFrame, hits: DataFrame, gone: DataFrame) -> DataFrame:
    removed = hits.join(gone, ["host", "line"]).groupBy("uid").agg(F.sum("words").cast("long").alias("removed_words"), F.collect_list("line").alias("removed"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))
    return (
        rows.drop("lines")
        .join(removed, "uid", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .select("doc_id", "host", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words", "signature", "removed")
    )


def verdicts(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, the base figures, base_failed, removed_words and kept."""
    return judged(docs, host, min_docs, share).drop("host", "row", "signature", "removed")


def without_lines(texts: pa.Array, removed: pa.ListArray) -> list[str]:
    """Texts without the lines of those hashes; the others are joined by newlines as before."""
    data, offsets = arrays.buffers(texts)
    a, _, row, line, _ = text_lines(data, offsets)
    gone = np.repeat(np.arange(len(removed)), removed.value_lengths().to_numpy(zero_copy_only=False))
    known = in_row(removed.flatten().to_numpy(zero_copy_only=False).view(np.uint64), gone)
    return _rejoined(data, offsets, set(a[np.isin(in_row(line, row), known)].tolist()))


def _rejoined(data: np.ndarray, offsets: np.ndarray, drop: set[int]) -> list[str]:
    """Texts without the lines that begin at some bytes."""
    blob, out = data.tobytes(), []
    for at, end in zip(offsets.tolist(), offsets[1:].tolist()):
        kept = []
        for piece in blob[at:end].split(b"\n"):
            if at not in drop:
                kept.append(piece)
            at += len(piece) + 1
        out.append(b"\n".join(kept).decode())
    return out


def of_host(line: np.ndarray, host: np.ndarray) -> np.ndarray:
    """Hashes of lines in hosts, from theirs."""
    return arrays.mix(line ^ arrays.mix(host + np.uint64(0x9E3779B97F4A7C15)))


def _acted(data: np.ndarray, offsets: np.ndarray, host: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """Whether each text is kept, and those that are and lose lines, without them. ``gone`` are sorted hashes of lines in hosts."""
    starts, ends, bounds = arrays.words(data, offsets)
    a, _, row, line, size = text_lines(data, offsets)
    key = of_host(line, host[row])
    hit = gone[np.minimum(np.searchsorted(gone, key), len(gone) - 1)] == key if len(gone) else np.zeros(len(key), bool)
    n, removed = np.diff(bounds), np.bincount(row[hit], size[hit], minlength=len(offsets) - 1)
    again = repeated_words(arrays.span_hashes(data, starts, ends), bounds)
    left = n - removed
    kept = ~((n < 10) | (100 * again > 20 * n)) & ~((removed > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * n)))
    texts: list[str | None] = [None] * len(n)
    for k in np.flatnonzero(kept & (removed > 0)).tolist():
        own = slice(*np.searchsorted(row, (k, k + 1)))
        texts[k] = _rejoined(data[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k], set((a[own][hit[own]] - offsets[k]).tolist()))[0]
    return kept, texts


def clean(docs: DataFrame, host: str = "source", chars: str = "n_chars", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """The rows that are kept, with all their columns, and without the lines above their host's limit. Where a text changes, the column
    ``chars``, if there is one, gets its new number of code points. Rows are told apart by doc_id, host and text; those that repeat are judged
    alike. The lines to remove are few (more than one document of fifty holds each): up to CARRIED of them go to all tasks, which then
    judge and cut each text where it is read; beyond that the input goes through one join."""
    rows, hits, gone = counted(docs, host, min_docs, share)
    if gone.limit(CARRIED + 1).count() > CARRIED:
        return _cleaned_by_join(docs, _verdicts(rows, hits, gone), host, chars)
    some = gone.select("line", F.xxhash64("host").alias("host")).toArrow()
    line, own = (some.column(c).to_numpy().view(np.uint64) for c in ("line", "host"))
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(of_host(line, own)))

    schema, names = docs.schema, docs.columns
    at, size = names.index("text"), names.index(chars) if chars in names else None

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.buffers(batch.column(at))
            of = batch.column(len(names)).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, j in arrays.slices(offsets):
                kept, texts = _acted(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], of[i:j], shared.value)
                columns = batch.slice(i, j - i).columns[: len(names)]
                if any(t is not None for t in texts):
                    changed = pa.array([t is not None for t in texts])
                    columns[at] = pc.if_else(changed, pa.array(texts, columns[at].type), columns[at])
                    if size is not None:
                        columns[size] = pc.if_else(changed, pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[size].type), columns[size])
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(kept))
        arrays.give_back()  # a worker lives on beside those of the next stages

    own_host = F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("\0")))
    return bounded(docs).select("*", own_host.alias(f"host_{uuid.uuid4().hex}")).mapInArrow(act, schema)


def _changed(rows: DataFrame, changed: Column, text: Column, chars: str, docs: DataFrame) -> DataFrame:
    """The documents (doc) with new texts where they have changed."""
    doc = F.col("doc").withField("text", F.when(changed, text).otherwise(F.col("doc.text")))
    if chars in docs.columns:
        doc = doc.withField(chars, F.when(changed, F.length(text)).otherwise(F.col(f"doc.{chars}")).cast(docs.schema[chars].dataType))
    return rows.select(doc.alias("doc")).select("doc.*")


def _cleaned_by_join(docs: DataFrame, every: DataFrame, host: str, chars: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "clean")
    every = every.select("doc_id", "host", "row", "kept", "removed")
    acted = scratch.save(every.filter(~F.col("kept") | F.col("removed").isNotNull()).dropDuplicates(["doc_id", "host", "row"]), "acted")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own_id"), F.col(host).cast("string").alias("own_host"), F.xxhash64("text").alias("own_row"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_host").eqNullSafe(F.col("host")) & (F.col("own_row") == F.col("row"))
    left = rows.join(acted, same, "left").filter(F.coalesce("kept", F.lit(True))).select("doc", "removed")

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, removed in batches:
            some = removed.notna().to_numpy()
            out = pd.Series([None] * len(texts), dtype=object)
            if some.any():
                own = pa.array(texts[some], pa.string(), from_pandas=True), pa.array(removed[some], pa.list_(pa.int64()))
                out[some] = without_lines(*own)
            yield out

    changed = F.col("removed").isNotNull()  # other texts needn't go to Python
    left = left.withColumn("cut", F.pandas_udf(cut, "string")(F.when(changed, F.col("doc.text")), F.col("removed")))
    return _changed(left, changed, F.col("cut"), chars, docs)
