"""Files: finding those to read, telling which have changed, and extracting their chunks.

Files are listed by a walk in tasks that enters no excluded folder (where only Spark knows a file system, by its binaryFile source); contents are loaded
of files that changed. An extractor is a plain function from bytes to chunks and runs in Python, once per file; a file that it can't
read becomes a document with an error, and never ends a job."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import schema
from corpuslens.sources import walk
from corpuslens.sources.extractors import extract_file

DEFAULT_EXCLUDES = (
    "**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/.next/**", "**/dist/**", "**/build/**", "**/.DS_Store",
)
CHUNK = (
    "workspace_id string, path string, content_sha256 string, error string, method string, ordinal int, chunk_kind string, page_number int, sheet_name string, "
    "cell_range string, slide_number int, section_heading string, text string, confidence double, parts int"
)


#: As many changed files are read by their names, each by itself; beyond, by a scan of the folder.
LISTED = 10_000


def _plain(path: Column) -> Column:
    """A path without the scheme of a local one."""
    return F.regexp_replace(path, "^file:/+", "/")


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a scan, dealt over all cores if it has fewer splits than there are cores: a small file of one row group would be
    one task. A scan with more splits stays as it is, and nothing is shuffled. Filters and pruning still reach the scan."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def discover(
    spark: SparkSession, root: str, workspace_id: str, extensions: list[str] | None = None, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, max_bytes: int | None = None, paths: DataFrame | None = None
) -> DataFrame:
    """workspace_id, path, name, kind, size_bytes, mtime of the files to index; contents aren't read. Hidden folders are left out,
    except ``.claude``. With ``paths`` (path), of these only, and nothing is listed."""
    rules, at = walk.Rules(excludes, extensions, max_bytes), walk.rooted(spark, root)
    if at is not None:
        found = walk.walk(spark, at, rules) if paths is None else walk.looked_up(paths, at, rules)
        return _described(found, workspace_id)
    rows = _scanned(spark, root, extensions, excludes, max_bytes)
    return _described(rows if paths is None else rows.join(paths.select("path").distinct(), "path", "left_semi"), workspace_id)


def _described(rows: DataFrame, workspace_id: str) -> DataFrame:
    path = F.col("path")
    return rows.select(
        F.lit(workspace_id).alias("workspace_id"), "path", schema.base_name(path).alias("name"), schema.kind_of(path).alias("kind"), "size_bytes", "mtime"
    ).filter(F.col("kind").isNotNull())


def _scanned(spark: SparkSession, root: str, extensions: list[str] | None, excludes: tuple[str, ...], max_bytes: int | None) -> DataFrame:
    """path, size_bytes, mtime by Spark's own listing, which enters every folder but hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    path = _plain(F.col("path"))
    below = F.substring(path, len(root.replace("file://", "").rstrip("/")) + 2, 2**31 - 1)
    rows = files.filter(~below.rlike(r"(^|/)\.(?!claude/)[^/]*/") & ~schema.base_name(path).startswith(".DS_Store"))
    if excludes:
        rows = rows.filter(~path.rlike("|".join(f"(?:{fnmatch.translate(g).replace('(?s:', '(?:').replace(chr(92) + 'z', '$').replace(chr(92) + 'Z', '$').replace('(?>', '(?:')})" for g in excludes)))
    if extensions is not None:
        wanted = [e.lower().lstrip(".") for e in extensions]
        rows = rows.filter(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(wanted))
    if max_bytes is not None:
        rows = rows.filter(F.col("length") <= max_bytes)
    return rows.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def changed(found: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """The files that aren't indexed, or are newer or of another size than when they were. ``known`` has the documents table's columns."""
    ids = found.withColumn("document_id", schema.document_id(F.col("workspace_id"), F.col("path")))
    if force:
        return ids
    was = known.filter(F.col("indexed_at").isNotNull()).select(F.col("id").alias("document_id"), F.col("mtime").alias("_mtime"), F.col("size_bytes").alias("_size"))
    same = F.coalesce((F.col("_mtime") >= F.col("mtime")) & (F.col("_size") == F.col("size_bytes")), F.lit(False))
    return ids.join(was, "document_id", "left").filter(~same).drop("_mtime", "_size")


def extract(spark: SparkSession, todo: DataFrame, root: str, options: dict | None = None) -> DataFrame:
    """One row per chunk of the files in ``todo``, or one with an error. The contents are read here, and only theirs."""
    options = options or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield pd.DataFrame(extract_file(row.workspace_id, row.path, row.kind, bytes(row.content), options), columns=[c.split(" ")[0] for c in CHUNK.split(", ")])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    some = [r.path for r in todo.select("path").limit(LISTED + 1).collect()]
    if len(some) <= LISTED:  # few changes: only their files are opened
        if not some:
            return spark.createDataFrame([], CHUNK)
        loaded = listed.load([re.sub(r"([][{}*?\\])", r"\\\1", p) for p in some])
    else:  # many: files older than all of them, or larger, aren't opened
        bound = todo.agg(F.min("mtime").alias("since"), F.max("size_bytes").alias("most")).first()
        loaded = listed.load(root).filter((F.col("modificationTime") >= F.lit(bound.since)) & (F.col("length") <= bound.most))
    files = loaded.select(_plain(F.col("path")).alias("path"), "content")
    return files.join(todo.select("workspace_id", "path", "kind"), "path").select("workspace_id", "path", "kind", "content").mapInPandas(run, CHUNK)


def tables(todo: DataFrame, extracted: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Rows for the tables of documents and of chunks."""
    doc_id = schema.document_id(F.col("workspace_id"), F.col("path"))
    whole = extracted.groupBy("workspace_id", "path").agg(
        F.max("content_sha256").alias("sha256"), F.max("error").alias("extraction_error"), F.max("method").alias("extraction_method"),
        F.max("parts").alias("parts"), F.count_if(F.col("chunk_kind").isin("page", "sheet", "slide")).alias("leaves"), F.count("ordinal").alias("chunks"),
    )
    of_kind = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("leaves").cast("int"))
    documents = todo.join(whole, ["workspace_id", "path"]).select(
        doc_id.alias("id"), "workspace_id", "path", "name", "kind", "size_bytes", "sha256", "mtime", F.lit(now).cast("timestamp").alias("indexed_at"),
        of_kind("pdf").alias("page_count"), of_kind("xlsx").alias("sheet_count"), of_kind("pptx").alias("slide_count"),
        (F.col("chunks") > 0).alias("has_extracted_text"), "extraction_method", "extraction_error",
    )
    chunks = extracted.filter(F.col("ordinal").isNotNull()).select(
        schema.chunk_id(doc_id, F.col("ordinal")).alias("id"), doc_id.alias("document_id"), "workspace_id", F.col("chunk_kind").alias("kind"), "ordinal", "page_number",
        "sheet_name", "cell_range", "slide_number", "section_heading", "text", F.length("text").alias("char_count"), "confidence", F.col("method").alias("extraction_method"),
    )
    return documents, chunks
