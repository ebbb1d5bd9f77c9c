"""Unified differences of two files as Spark tables of lines.

Lines that stand once in either file are anchors. Anchors side by side in both files make a run; of all runs the chain that
rises in both files and holds most lines is kept. What is between kept runs is a gap, taken away and added. Finding anchors and runs is
joins and grouping by line; one task only sees three numbers a run, and then the lines of the gaps with their context, which is what
it writes. So it sees as much as the differences are long, not the files.

A gap of at most FINE lines a side is compared once more line by line, so that lines which stand several times are kept in it."""

from __future__ import annotations

import difflib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTEXT, FINE = 3, 500
#: How the two files are named in a difference, and what is said if there is none.
OLD_LABEL, NEW_LABEL = "{} (existing)", "{} (proposed)"
SAME = "(no textual difference between {} and the proposed overwrite — the file would be rewritten with identical contents)"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """k (from 0) and line of a file. Lines are counted in each block of the file; only the blocks are put in order together."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(blocks.withColumn("before", before)), "block").select((F.col("before") + F.col("m") - F.col("first")).alias("k"), "line")  # a row a block of the file


def runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """i, j, n: runs of anchors, by their first lines and their length."""
    once = lambda rows, name: rows.groupBy("line").agg(F.count("*").alias("c"), F.min("k").alias(name)).filter("c = 1").select("line", name)
    pairs = once(old, "i").join(once(new, "j"), "line").select("i", "j", (F.col("i") - F.col("j")).alias("d"))
    beside = lambda step: pairs.select((F.col("i") + step).alias("i"), (F.col("j") + step).alias("j"))
    edges = pairs.join(beside(1), ["i", "j"], "left_anti").select("i", "j", "d", F.lit(0).alias("end")).unionByName(pairs.join(beside(-1), ["i", "j"], "left_anti").select("i", "j", "d", F.lit(1).alias("end")))
    last = F.lead("i").over(Window.partitionBy("d").orderBy("i", "end"))
    return edges.withColumn("last", last).filter("end = 0").select("i", "j", (F.col("last") - F.col("i") + 1).alias("n"))


def chain(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of runs (i, j, n) by i, those of the rising chain with most lines; the first of equal ones."""
    places = sorted(j for _, j, _ in found)
    tree: list[tuple[int, int]] = [(0, -1)] * (len(found) + 1)  # the best (lines, run) among the first j
    before = [-1] * len(found)
    best = (0, -1)
    for r, (_, j, n) in enumerate(found):
        at = bisect_left(places, j)
        k, top = at, (0, -1)
        while k:
            top, k = max(top, tree[k], key=lambda x: x[0]), k & (k - 1)
        before[r], own, k = top[1], (top[0] + n, r), at + 1
        while k <= len(found):
            tree[k], k = max(tree[k], own, key=lambda x: x[0]), k + (k & -k)
        best = max(best, own, key=lambda x: x[0])
    out, r = [], best[1]
    while r >= 0:
        out.append(found[r])
        r = before[r]
    return out[::-1]


GAP = "i long, i_end long, j long, j_end long"


def gaps(old: DataFrame, new: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """i, i_end, j, j_end: the stretches between the kept runs that aren't empty. ``sizes`` are the numbers of lines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame(columns=["i", "j", "n"]), *frames])
        at, out = (0, 0), []
        known = sorted(map(tuple, held[held["n"] > 0].astype("int64").to_numpy().tolist()))
        for i, j, n in [*chain(known), (*sizes, 0)]:
            if i > at[0] or j > at[1]:
                out.append((at[0], i, at[1], j))
            at = (i + n, j + n)
        yield pd.DataFrame(out, columns=["i", "i_end", "j", "j_end"])

    end = old.sparkSession.createDataFrame([(*sizes, 0)], "i long, j long, n long")  # there may be no run at all
    return runs(old, new).unionByName(end).repartition(1).mapInPandas(run, GAP)


def fine(i: int, old: list[str], j: int, new: list[str]) -> list[tuple[int, int, int, int]]:
    """The changes in a gap: without lines that it begins or ends with in both files, and, if it is short, compared line by line."""
    a, b = 0, 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    old, new, i, j = old[a : len(old) - b], new[a : len(new) - b], i + a, j + a
    if not old and not new:
        return []
    if max(len(old), len(new)) > FINE:
        return [(i, i + len(old), j, j + len(new))]
    return [(i + p, i + q, j + r, j + s) for tag, p, q, r, s in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if tag != "equal"]


def _range(start: int, end: int) -> str:
    n = end - start
    return f"{start + 1}" if n == 1 else f"{start + (n > 0)},{n}"


def hunks(changes: list[tuple[int, int, int, int]], old: dict[int, str], new: dict[int, str], size: int, context: int) -> Iterator[str]:
    """The lines of a unified difference; changes that are at most twice the context apart share a hunk."""
    k = 0
    while k < len(changes):
        n = k + 1
        while n < len(changes) and changes[n][0] - changes[n - 1][1] <= 2 * context:
            n += 1
        part = changes[k:n]
        lead = min(context, part[0][0])
        tail = min(context, size - part[-1][1])
        yield f"@@ -{_range(part[0][0] - lead, part[-1][1] + tail)} +{_range(part[0][2] - lead, part[-1][3] + tail)} @@"
        at = part[0][0] - lead
        for i, i_end, j, j_end in part:
            yield from (" " + old[x] for x in range(at, i))
            yield from ("-" + old[x] for x in range(i, i_end))
            yield from ("+" + new[x] for x in range(j, j_end))
            at = i_end
        yield from (" " + old[x] for x in range(at, at + tail))
        k = n


def unified(old: DataFrame, new: DataFrame, old_label: str, new_label: str, context: int = CONTEXT) -> DataFrame:
    """place and value: the lines of the unified difference of two tables of lines (k, line); none if they are the same."""
    size = old.count()
    found = gaps(old, new, (size, new.count()))
    reach = found.select(F.greatest(F.lit(0), F.col("i") - context).alias("first"), (F.least(F.lit(size), F.col("i_end") + context) - 1).alias("last"))
    near = reach.filter("first <= last").select(F.explode(F.sequence("first", "last")).alias("k")).distinct()
    added = found.filter("j_end > j").select(F.explode(F.sequence("j", F.col("j_end") - 1)).alias("k"))
    empty = F.lit(None).cast("long")
    rows = (
        found.select(F.lit("g").alias("side"), "i", "i_end", "j", "j_end", F.lit("").alias("line"))
        .unionByName(old.join(near, "k", "left_semi").select(F.lit("a").alias("side"), F.col("k").alias("i"), empty.alias("i_end"), empty.alias("j"), empty.alias("j_end"), "line"))
        .unionByName(new.join(added, "k", "left_semi").select(F.lit("b").alias("side"), F.col("k").alias("i"), empty.alias("i_end"), empty.alias("j"), empty.alias("j_end"), "line"))
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(frames) or [pd.DataFrame(columns=["side", "i", "i_end", "j", "j_end", "line"])])
        side = lambda s: held[held["side"] == s]
        a, b = (dict(zip(side(s)["i"].astype(int), side(s)["line"])) for s in "ab")
        changes = []
        for i, i_end, j, j_end in sorted(map(tuple, side("g")[["i", "i_end", "j", "j_end"]].astype("int64").to_numpy().tolist())):
            changes += fine(i, [a[x] for x in range(i, i_end)], j, [b[x] for x in range(j, j_end)])
        if changes:
            out = [f"--- {old_label}", f"+++ {new_label}", *hunks(changes, a, b, size, context)]
            yield pd.DataFrame({"place": range(len(out)), "value": out})

    return rows.repartition(1).mapInPandas(run, "place long, value string")


def write_single(write, spark: SparkSession, path: str) -> None:  # noqa: ANN001
    """One file at a path, in place of what is there: ``write`` writes a folder of one part file, which is moved."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, folder = base(path), base(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(folder.toString())
        part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        fs.delete(target, True)
        if not fs.rename(part, target):
            raise OSError(f"{path} could not be written")
    finally:
        fs.delete(folder, True)


def write_difference(spark: SparkSession, old_path: str, new_path: str, to: str) -> bool:
    """Writes the unified difference of two files as one file, or a note that there is none; whether there is one."""
    name = old_path.rsplit("/", 1)[-1]
    lines = unified(numbered(spark, old_path), numbered(spark, new_path), OLD_LABEL.format(name), NEW_LABEL.format(name)).persist()
    try:
        some = not lines.isEmpty()
        out = lines.orderBy("place").select("value") if some else spark.createDataFrame([(SAME.format(name),)], "value string")
        write_single(lambda at: out.coalesce(1).write.text(at), spark, to)
    finally:
        lines.unpersist()
    return some
