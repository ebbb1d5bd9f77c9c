"""Tables of a collection: documents, chunks, fields, entities, vectors, the inverted index, workspaces, audit trail.

A table is dealt to parts by a hash of the document's id. A change writes the parts it touches beside the old ones, for all tables
it concerns, and then adds one entry to a log that names the folder of each part. So a change costs what its parts hold, a reader
sees all of it or nothing, and an interrupted one leaves the old state. Of the rows, only numbers of parts are collected.

A change reads one state and its entry follows that state's number; an entry is only added where there is none. So a writer whose
state another one has replaced meanwhile gets an error, and nothing of either is lost. That needs a file system that creates a name
only once: a local one (by hard links), or one whose rename fails on a name that is there, as HDFS does."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.schema import TABLES


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows, and the old ones that no new row replaces. Columns in ``keep`` stay as they were where a row is replaced."""
    if keep:
        was = old.select(F.col(key), *(F.col(c).alias(f"_old_{c}") for c in keep))
        new = new.join(was, key, "left").select(*(F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns))
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, documents: DataFrame, parent: str = "document_id") -> DataFrame:
    """All rows of the given documents go, the new ones come; a document without new rows has none then."""
    ids = documents.select(parent).distinct()
    return old.join(ids, parent, "left_anti").unionByName(new)


def replace_prefix(old: DataFrame, new: DataFrame, documents: DataFrame, prefix: str, parent: str = "document_id") -> DataFrame:
    """As replace_children, for the fields whose keys start so."""
    ids = documents.select(parent).distinct()
    own, other = old.filter(F.col("key").startswith(prefix)), old.filter(~F.col("key").startswith(prefix))
    return other.unionByName(own.join(ids, parent, "left_anti")).unionByName(new)


def without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def patch(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Values of ``new`` where they aren't null, else the old ones; rows without a patch stay."""
    given = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key))
    pick = [F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in given.columns else F.col(c) for c in old.columns]
    return old.join(given, key, "left").select(*pick)


def fitting_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """The vectors of a dimension, and the rows that tell why there is none."""
    return vectors.filter(F.col("embedding").isNull() | (F.size("embedding") == dim))


#: Tables whose rows hang on a document.
CHILDREN = ("postings", "lengths", "vectors", "entities", "grams", "fields", "chunks")


class Store:
    """The tables under a folder that all executors reach. ``parts`` counts when a store is begun; it stays with the store."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    # ---- the log: {"parts": n, "now": {table: {part: folder}}, "before": the same of the state that changed last}

    def _fs(self):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict]:
        path, fs = self._fs()
        folder = path(f"{self.root}/_log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return -1, {"parts": self.parts, "now": {}, "before": {}}
        stream = fs.open(path(folder, names[-1]))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(names[-1].split(".")[0]), json.loads(text)

    def _log(self, number: int, state: dict) -> None:
        """Adds an entry; an error if another writer was faster. Files of entries before the last one go."""
        path, fs = self._fs()
        entry, draft = path(f"{self.root}/_log/{number:012d}.json"), path(f"{self.root}/_log/{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        try:
            if not self._create(fs, draft, entry):
                raise RuntimeError("another writer has changed the store; nothing was changed here")
        finally:
            fs.delete(draft, False)
        for status in fs.listStatus(path(f"{self.root}/_log")):
            name = status.getPath().getName()
            if name.endswith(".json") and int(name.split(".")[0]) < number - 1:
                fs.delete(status.getPath(), False)

    def _create(self, fs, draft, entry) -> bool:  # noqa: ANN001
        """Gives a written file its name in one step; False if the name is taken."""
        jvm = self.spark.sparkContext._jvm
        try:
            if fs.getUri().getScheme() == "file":
                files, local = jvm.java.nio.file.Files, jvm.java.nio.file.Paths
                files.createLink(local.get(fs.makeQualified(entry).toUri()), local.get(fs.makeQualified(draft).toUri()))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, entry, none)
        except Exception:  # noqa: BLE001
            if fs.exists(entry):
                return False
            raise
        return True

    # ---- tables

    def _part(self, key: str | None, parts: int) -> Column:
        return (F.pmod(F.xxhash64(key), F.lit(parts)) if key else F.lit(0)).cast("int").alias("part")

    def read(self, name: str, parts: set[int] | None = None, state: dict | None = None) -> DataFrame:
        """The table's last whole state (or that of ``state``), or some parts of it; empty before the first write."""
        if name == "audit_log":
            path, fs = self._fs()
            folders = [f"{self.root}/{name}"] if fs.exists(path(f"{self.root}/{name}")) else []
        else:
            now = (state or self._state()[1])["now"].get(name, {})
            folders = [f"{self.root}/{at}" for part, at in now.items() if parts is None or int(part) in parts]
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def typed(self, name: str, df: DataFrame) -> DataFrame:
        """The table's columns in its types, null where there are none."""
        wanted = self.spark.createDataFrame([], TABLES[name]).schema
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))

    def commit(self, changes: dict[str, DataFrame], touched: set[int] | None = None, base: tuple[int, dict] | None = None) -> None:
        """New states of some tables, or of their ``touched`` parts, in one step after the state ``base`` that they were made from; an error if
        that isn't the last one any more. What the step before had stays for those reading it."""
        number, state = base or self._state()
        path, fs = self._fs()
        now, before, folders = dict(state["now"]), dict(state["before"]), []
        for name, rows in changes.items():
            key = {"documents": "id", "workspaces": None, "centres": None}.get(name, "document_id")
            typed = self.typed(name, rows)
            order = {"postings": ["term"], "grams": ["gram", "low"], "vectors": ["cell", "away"]}.get(name) or [c for c in ("workspace_id", "document_id", "id") if c in typed.columns]  # a search reads few row groups
            at = f"{name}/{number + 1:012d}-{uuid.uuid4().hex[:8]}"
            folders.append(at)
            dealt = typed.withColumn("part", self._part(key, state["parts"])).hint("rebalance", "part")  # a large part becomes several files
            dealt.sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{self.root}/{at}")
            written = {n.split("=")[1]: f"{at}/{n}" for s in fs.listStatus(path(f"{self.root}/{at}")) if (n := s.getPath().getName()).startswith("part=")}
            old = state["now"].get(name, {})
            before[name] = old
            now[name] = {p: f for p, f in old.items() if touched is not None and key and int(p) not in touched} | written
        try:
            self._log(number + 1, {"parts": state["parts"], "now": now, "before": before})
        except RuntimeError:
            for at in folders:
                fs.delete(path(f"{self.root}/{at}"), True)
            raise
        for name in changes:
            used = {f.split("/")[1] for f in (*now[name].values(), *before[name].values())}
            for status in fs.listStatus(path(f"{self.root}/{name}")):
                folder = status.getPath().getName()
                if folder not in used and int(folder.split("-")[0]) <= number:
                    fs.delete(status.getPath(), True)

    def write(self, name: str, df: DataFrame) -> None:
        """A new state of a table, whatever it was before."""
        self.commit({name: df})

    def update(self, name: str, how: Callable[[DataFrame], DataFrame]) -> None:
        """A new state of a whole table, made from the old one."""
        base = self._state()
        self.commit({name: how(self.read(name, state=base[1]))}, base=base)

    def change(self, ids: DataFrame, how: dict[str, Callable[[DataFrame], DataFrame]], also: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
        """Changes tables where they concern some documents (document_id), in one step: ``how`` makes the new rows of the parts
        that hold them from the old rows of these parts. Other parts are neither read nor written. ``also`` makes new states of
        tables that aren't dealt by documents, in the same step."""
        base = self._state()
        count = base[1]["parts"]
        parts = {r.part for r in ids.select(self._part("document_id", count)).distinct().collect()}  # as many as there are parts at most
        new = {name: make(self.read(name, parts, base[1])) for name, make in how.items()} if parts else {}
        new |= {name: make(self.read(name, state=base[1])) for name, make in (also or {}).items()}
        if new:
            self.commit(new, parts, base)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to the trail, without touching those that are there."""
        self.typed(name, df).write.mode("append").parquet(f"{self.root}/{name}")

    def delete_documents(self, ids: DataFrame, also: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
        """Documents (document_id) and all that hangs on them."""
        ids = ids.select("document_id").distinct()
        own = {name: (lambda old: without(old, ids, "document_id")) for name in CHILDREN}
        self.change(ids, own | {"documents": lambda old: without(old, ids.withColumnRenamed("document_id", "id"), "id")}, also)

    def delete_workspace(self, workspace_id: str) -> None:
        """A workspace and all its documents, in one step."""
        own = self.read("documents").filter(F.col("workspace_id") == workspace_id).select(F.col("id").alias("document_id"))
        self.delete_documents(own, {"workspaces": lambda old: old.filter(F.col("id") != workspace_id)})
