"""Listing trees of files in tasks, without entering folders that are left out.

Open folders are rows. In a round, each task lists its share of them and goes on below, up to a number of folders; what it has not
entered by then it gives back, and the next round deals that over all tasks anew. So one deep subtree is not one task's
work, a round's result is a table in the shared folder (a lost executor costs its part of a round), and the driver only learns whether folders are left.

Folders are left out if they are hidden (but for ``.claude``), match an exclude glob, or if all that could stand in them
would; symbolic links to folders are not followed. Folders and files that can't be read are passed over. Local and mounted file systems are read by the operating system, others
by pyarrow where it knows their scheme."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.plans.work import shared_folder

ENTRY = "folder boolean, path string, size_bytes long, mtime timestamp"
#: Folders that a task enters in the first round, and at most in a later one.
FIRST, MOST = 16, 4096
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs")


class Rules:
    """Which folders to enter and which files to list; paths as the walk spells them, without the scheme of a local one."""

    def __init__(self, excludes: tuple[str, ...] = (), extensions: list[str] | None = None, max_bytes: int | None = None):
        self.extensions = None if extensions is None else {e.lower().lstrip(".") for e in extensions}
        self.max_bytes = max_bytes
        self.files = [re.compile(fnmatch.translate(g)) for g in excludes]
        self.below = [p for p, g in zip(self.files, excludes) if g.endswith("*")]  # what ends in a star matches all that begins as it does

    def enters(self, path: str, name: str) -> bool:
        if name == ".claude":
            return True
        return not (name.startswith(".") or any(p.match(path) for p in self.files) or any(p.match(path + "/") for p in self.below))

    def lists(self, path: str, name: str, size: int) -> bool:
        if name.startswith(".DS_Store") or any(p.match(path) for p in self.files):
            return False
        if self.extensions is not None and os.path.splitext(name)[1].lower().lstrip(".") not in self.extensions:
            return False
        return self.max_bytes is None or size <= self.max_bytes

    def reaches(self, root: str, path: str) -> bool:
        """If a walk from the root would come to the folder of a path."""
        at = root.rstrip("/")
        for name in path[len(at) + 1 :].split("/")[:-1]:
            at = f"{at}/{name}"
            if not self.enters(at, name):
                return False
        return path.startswith(root.rstrip("/") + "/")


def entries(folder: str) -> Iterator[tuple[bool, str, int, datetime]]:
    """What stands in a folder: if it is a folder, path, bytes, time of its last change in whole milliseconds."""
    if "://" not in folder:
        try:
            found = list(os.scandir(folder))
        except OSError:
            return
        for e in found:
            try:
                if e.is_dir(follow_symlinks=False):
                    yield True, f"{folder.rstrip('/')}/{e.name}", 0, datetime.fromtimestamp(0, timezone.utc)
                elif e.is_file():
                    s = e.stat()
                    yield False, f"{folder.rstrip('/')}/{e.name}", s.st_size, moment(s.st_mtime_ns)
            except OSError:
                continue
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(inner)] if folder.endswith(inner) else folder.split("://")[0] + "://"
    for e in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        yield e.type == fs.FileType.Directory, prefix + e.path, e.size or 0, moment(e.mtime_ns or 0)


def moment(nanoseconds: int) -> datetime:
    return datetime.fromtimestamp(nanoseconds // 1_000_000 / 1000, timezone.utc)


def visit(folders: list[str], rules: Rules, most: int) -> Iterator[tuple[bool, str, int, datetime]]:
    """The files below some folders, of which ``most`` are entered; those that are left come as folders."""
    stack, entered = list(folders), 0
    while stack and entered < most:
        entered += 1
        for is_folder, path, size, mtime in entries(stack.pop()):
            name = path.rsplit("/", 1)[1]
            if is_folder and rules.enters(path, name):
                stack.append(path)
            elif not is_folder and rules.lists(path, name, size):
                yield False, path, size, mtime
    for path in stack:
        yield True, path, 0, datetime.fromtimestamp(0, timezone.utc)


def rooted(spark: SparkSession, root: str) -> str | None:
    """The root as the walk spells it; None where only Spark can list it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if uri.getScheme() not in SCHEMES:
        return None
    return uri.getPath() if uri.getScheme() == "file" else str(uri)


def _frames(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pd.DataFrame]:
    names, held = [c.split(" ")[0] for c in ENTRY.split(", ")], []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def walk(spark: SparkSession, root: str, rules: Rules, first: int = FIRST, most: int = MOST) -> DataFrame:
    """path, size_bytes, mtime of the files below a root, as ``rooted`` spells it."""
    base, round_, rows = shared_folder(spark, "walk"), 0, []
    tasks = 2 * spark.sparkContext.defaultParallelism
    open_ = spark.createDataFrame([(root,)], "path string")
    while True:
        budget = min(most, first << round_)

        def run(frames: Iterator[pd.DataFrame], budget: int = budget) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield from _frames(visit(frame["path"].tolist(), rules, max(budget, len(frame))))

        (open_ if round_ == 0 else open_.repartition(tasks)).mapInPandas(run, ENTRY).write.partitionBy("folder").parquet(f"{base}/{round_}")
        found = spark.read.schema(ENTRY).parquet(f"{base}/{round_}")
        rows.append(f"{base}/{round_}")
        open_ = found.filter("folder").select("path")
        round_ += 1
        if open_.isEmpty():
            break
    out = [spark.read.schema(ENTRY).parquet(at).filter("NOT folder").select("path", "size_bytes", "mtime") for at in rows]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def looked_up(paths: DataFrame, root: str, rules: Rules) -> DataFrame:
    """As ``walk``, of some paths only: each is looked up by itself, and nothing is listed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(frame: pd.DataFrame) -> Iterator[tuple]:
            for path in frame["path"]:
                size, mtime = _looked_up(path)
                if mtime is not None and rules.reaches(root, path) and rules.lists(path, path.rsplit("/", 1)[1], size):
                    yield False, path, size, mtime

        for frame in frames:
            yield from _frames(rows(frame))

    return paths.select("path").distinct().mapInPandas(run, ENTRY).select("path", "size_bytes", "mtime")


def _looked_up(path: str) -> tuple[int, datetime | None]:
    if "://" not in path:
        try:
            s = os.stat(path)
        except OSError:
            return 0, None
        return (s.st_size, moment(s.st_mtime_ns)) if os.path.isfile(path) else (0, None)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    return (info.size, moment(info.mtime_ns or 0)) if info.type == fs.FileType.File else (0, None)
