"""Events of the files in a folder, as a stream that nobody has to bring.

A streaming source lists the folder once a step, in tasks, each some of the first level's subfolders. Files are dealt to buckets by a
hash of their path; a stateful operator keeps for each bucket the size and time of its files and compares: what is new, has
changed or is gone is an event. A file that is still changing waits until a step finds it as the step before did, so the trigger's step is
the time for which events gather. The first listing is where a watch begins: it makes no events.

The state is in RocksDB, as ``transformWithStateInPandas`` wants it; a watch that starts again from its checkpoint
finds what has changed since it stopped. A bucket's listing is compared by one task; more files want more buckets."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuslens.sources import walk

LISTED = "bucket int, tick long, path string, size_bytes long, changed long"
CHANGES = "path string, dest_path string, event_type string, is_directory boolean, seq long"
BUCKETS, TASKS = 64, 8
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FolderSource(DataSource):
    """``spark.readStream.format("folder_listing")`` with options root, excludes (parted by newlines), buckets and tasks."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema) -> FolderReader:  # noqa: ANN001, N802
        o = self.options
        return FolderReader(o["root"], tuple(x for x in o.get("excludes", "").split("\n") if x), int(o.get("buckets", BUCKETS)), int(o.get("tasks", TASKS)))


class Share(InputPartition):
    def __init__(self, place: int, tick: int):
        self.place, self.tick = place, tick


class FolderReader(DataSourceStreamReader):
    def __init__(self, root: str, excludes: tuple[str, ...], buckets: int, tasks: int):
        self.root, self.rules, self.buckets, self.tasks = root, walk.Rules(excludes), buckets, tasks

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"tick": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(k, end["tick"]) for k in range(self.tasks)]

    def read(self, partition: Share) -> Iterator[tuple]:
        place = lambda path, n: zlib.crc32(path.encode("utf-8", "surrogateescape")) % n
        if partition.place == 0:  # each bucket hears of each step, also an empty one
            yield from ((k, partition.tick, None, None, None) for k in range(self.buckets))
        below = []
        for is_folder, path, size, mtime in walk.entries(self.root):
            name = path.rsplit("/", 1)[1]
            if is_folder and place(path, self.tasks) == partition.place and self.rules.enters(path, name):
                below.append(path)
            elif not is_folder and partition.place == 0 and self.rules.lists(path, name, size):
                yield place(path, self.buckets), partition.tick, path, size, int(mtime.timestamp() * 1000)
        for _, path, size, mtime in walk.visit(below, self.rules, 2**62):
            yield place(path, self.buckets), partition.tick, path, size, int(mtime.timestamp() * 1000)

    def commit(self, end: dict) -> None:
        pass


SETTLED, NEW, CHANGED = 0, 1, 2


class Differences(StatefulProcessor):
    """What a bucket's files have done since the listing before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "path string", "size_bytes long, changed long, stage int")
        self.begun = handle.getValueState("begun", "tick long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        tick, now = -1, {}
        for frame in rows:
            for t, path, size, changed in zip(frame["tick"].tolist(), frame["path"], frame["size_bytes"], frame["changed"]):
                if t > tick:
                    tick, now = t, {}
                if t == tick and isinstance(path, str):
                    now[path] = (int(size), int(changed))
        out = []
        first = not self.begun.exists()
        was = {k[0]: v for k, v in self.known.iterator()} if not first else {}
        for path, (size, changed, stage) in was.items():
            if path not in now:
                self.known.removeKey((path,))
                if stage != NEW:
                    out.append((path, "deleted"))
            elif now[path] != (size, changed):
                self.known.updateValue((path,), (*now[path], NEW if stage == NEW else CHANGED))
            elif stage != SETTLED:
                self.known.updateValue((path,), (size, changed, SETTLED))
                out.append((path, "created" if stage == NEW else "modified"))
        for path, seen in now.items():
            if path not in was:
                self.known.updateValue((path,), (*seen, SETTLED if first else NEW))
        if first:
            self.begun.update((tick,))
        if out:
            yield pd.DataFrame({"path": [p for p, _ in out], "dest_path": None, "event_type": [e for _, e in out], "is_directory": False, "seq": tick})

    def close(self) -> None:
        pass


def folder_events(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), buckets: int | None = None, tasks: int | None = None) -> DataFrame:
    """The stream of events of a folder's files, in the columns that ``watch`` takes. Sets the session's state store to RocksDB."""
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    listed = spark.readStream.format("folder_listing").options(root=root, excludes="\n".join(excludes), buckets=str(buckets or BUCKETS), tasks=str(tasks or TASKS)).load()
    return listed.groupBy("bucket").transformWithStateInPandas(Differences(), CHANGES, "update", "None")
