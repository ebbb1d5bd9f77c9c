"""Fill-in-the-middle: texts cut into prefix, middle and suffix at units, and put together so that the middle comes last.

Positions in a text are bits of Python's unbounded integers. ``bytes.translate`` turns a text into the digits of a mask of a class
of bytes, a shifted mask marks where units start, ``bit_count`` gives their number, and the k-th of them is found by halving the
mask again and again, which reads each bit about twice in all. So a text of any length is worked on whole, in linear time.

Cuts and forms come from a hash of the seed and the document's id, so they are the same whenever and wherever it is run. Null
texts count as empty; a null doc_id is hashed as an empty string and stays null; rows that repeat get the same form; columns beside
doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import arrays
from corpuslens.llm.scratch import bounded

TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Digits of the masks: line feeds, and bytes that begin a code point.
FEEDS = bytes(49 if b == 10 else 48 for b in range(256))
POINTS = bytes(48 if b & 0xC0 == 0x80 else 49 for b in range(256))


@dataclass(frozen=True)
class Marks:
    """The strings before prefix, suffix and middle. None holds the first character of another, or its own again, so that a mark
    put after a text that holds no mark is found where it was put."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = (self.prefix, self.suffix, self.middle)
        if len(set(every)) < 3 or any(not m or any(x[0] in m[1:] for x in every if x) for m in every):
            raise ValueError("marks must differ, and no mark's first character may stand inside a mark")


def mask(data: bytes, digits: bytes) -> int:
    """An integer whose bit i says if byte i is in a class."""
    return int(data.translate(digits)[::-1], 2) if data else 0


def unit_starts(data: bytes) -> int:
    """A mask of the bytes at which lines start; a line ends with its line feed."""
    return (mask(data, FEEDS) << 1 | 1) & ((1 << len(data)) - 1)


def select(bits: int, rank: int) -> int:
    """The place of the set bit that has ``rank`` set bits below it."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    return at


def cut(data: bytes, starts: int, n: int, units: int) -> int:
    """The byte after so many units."""
    return len(data) if units >= n else select(starts, units)


def hashes(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def arrange(text: str, doc_id: int | None, seed: int, rate: int, spm_rate: int, marks: Marks) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (none if plain), and the output."""
    data = text.encode()
    starts = unit_starts(data)
    n, (h1, h2, h3, h4) = starts.bit_count(), hashes(doc_id, seed)
    if not data or any(m in text for m in (marks.prefix, marks.suffix, marks.middle)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (cut(data, starts, n, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    points = mask(data, POINTS)
    chars = (points & ((1 << a) - 1)).bit_count()
    inner = (points >> a & ((1 << b - a) - 1)).bit_count()
    prefix, middle, suffix = marks.prefix + text[:chars], marks.middle + text[chars : chars + inner], marks.suffix + text[chars + inner :]
    return (n, "spm", chars, inner, suffix + prefix + middle) if h4 % 100 < spm_rate else (n, "psm", chars, inner, prefix + suffix + middle)


def rebuilt(output: str, form: str, marks: Marks = Marks()) -> str:
    """The text, from an output and its form."""
    if form == "plain":
        return output
    order = {"psm": (marks.prefix, marks.suffix, marks.middle), "spm": (marks.suffix, marks.prefix, marks.middle)}[form]
    found, rest = {}, output
    for mark, following in zip(order, (*order[1:], None)):
        if not rest.startswith(mark):
            raise ValueError(f"no {mark} where the form {form} has it")
        end = len(rest) if following is None else rest.index(following, len(mark))
        found[mark], rest = rest[len(mark) : end], rest[end:]
    return found[marks.prefix] + found[marks.middle] + found[marks.suffix]


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: Marks = Marks()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each document. ``rate`` of 100 documents are taken apart,
    ``spm_rate`` of 100 of these have the suffix first; texts that are empty or hold a mark stay plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in arrays.text_slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            rows = [arrange(t or "", i, seed, rate, spm_rate, marks) for t, i in zip(batch.column(1).to_pylist(), ids)]
            n, form, prefix, middle, output = zip(*rows)
            long, string = pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, long), pa.array(form, string), pa.array(prefix, long), pa.array(middle, long), pa.array(output, string)],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TRANSFORMED)


def restore(transformed: DataFrame, marks: Marks = Marks()) -> DataFrame:
    """The rows with ``text`` rebuilt from output and form alone."""
    schema = transformed.select("*", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in arrays.text_slices(batches, "output"):
            texts = [rebuilt(o, f, marks) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return transformed.mapInArrow(run, schema)


def digest(transformed: DataFrame) -> DataFrame:
    """The columns of ``transform`` with hashes in place of texts: of the output, and of the text that is rebuilt from it."""
    sha = lambda name: F.sha2(F.encode(F.col(name), "UTF-8"), 256)
    return restore(transformed).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("text").alias("restored_sha256"))
