"""Fields that need a human eye, and what a folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, LIMIT, NEWEST = 0.7, 200, 2000


def low_confidence(fields: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """The least sure fields under the threshold, without clauses: document_id, path, name, key, value, confidence."""
    if not 0 < threshold <= 1 or limit < 1:
        raise ValueError("threshold must be above 0 and at most 1, limit at least 1")
    low = fields.filter((F.col("confidence") < threshold) & ~F.col("key").startswith("section."))
    rows = low.join(docs.select("document_id", "path", "name"), "document_id")
    return rows.orderBy("confidence", "document_id", "key", "value").limit(limit).select("document_id", "path", "name", "key", "value", F.round("confidence", 3).alias("confidence"))


def grouped(items: DataFrame) -> DataFrame:
    """Items by document, in the order of paths."""
    item = F.struct("confidence", "key", "value")
    return items.groupBy("document_id", "path", "name").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count("*").alias("item_count")).orderBy("path")


def totals(fields: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """How many documents and items the review has, and whether the limit cut it."""
    shown = low_confidence(fields, docs, threshold, limit + 1)
    return shown.agg(F.least(F.count("*"), F.lit(limit)).alias("items"), F.count_distinct("document_id").alias("documents"), (F.count("*") > limit).alias("truncated"))


def folder_summary(docs: DataFrame, newest: int = NEWEST) -> DataFrame:
    """Documents by kind, among the newest of the folder."""
    return docs.orderBy(F.desc("mtime"), "document_id").limit(newest).groupBy("kind").agg(F.count("*").alias("documents"))


def recent(docs: DataFrame, limit: int = 20) -> DataFrame:
    return docs.orderBy(F.desc("mtime"), "document_id").limit(limit).select("document_id", "name", "path", "kind", "mtime")
