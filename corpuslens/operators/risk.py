"""Risk of operations, gates in front of them, and the audit trail."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.schema import AUDIT

#: Operations by level, and the number of rows that may change without being asked.
LOW = ("search", "read", "extract", "summarize", "draft", "list", "describe")
MEDIUM = ("copy", "export_csv", "export_markdown", "export_json", "new_draft", "rename_proposal")
HIGH = ("overwrite", "delete", "send_email", "upload_external")
BULK_ROWS = 5


def _known(op: Column, names: tuple[str, ...]) -> Column:
    return op.isin(*names)


def outside(target: Column, root: Column) -> Column:
    """Whether a normal path lies outside a root."""
    return (target != root) & ~target.startswith(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))


def normal_path(path: str, root: str) -> str:
    """An absolute path without ``.`` and ``..``; a relative one is under the root."""
    return posixpath.normpath(posixpath.join(root, path))


def assess(operations: DataFrame) -> DataFrame:
    """Adds level, reasons, tripped and requires_confirmation. Columns: operation, targets (normal paths), row_count, confirm, and
    of the workspace name, root_path and policy (null without a workspace)."""
    op = F.lower(F.trim("operation"))
    many = (op == "bulk_modify") & (F.coalesce("row_count", F.lit(0)) > BULK_ROWS)
    tripped = many | (op == "confirmable_overwrite")
    base = F.when(_known(op, HIGH), "high").when(_known(op, LOW), "low").otherwise("medium")
    unknown = ~_known(op, (*LOW, *MEDIUM, *HIGH, "bulk_modify", "confirmable_overwrite"))
    read_only = F.coalesce(F.col("policy") == "read-only", F.lit(False)) & (base != "low")
    first_out = F.get(F.filter(F.coalesce("targets", F.array().cast("array<string>")), lambda t: outside(t, F.col("root_path"))), F.lit(0))
    escaped = F.col("root_path").isNotNull() & first_out.isNotNull()
    say = lambda test, *parts: F.when(test, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    reasons = F.array_compact(
        F.array(
            say(op == "bulk_modify", "many changes at once"),
            say(many, F.col("row_count").cast("string"), f" rows are more than {BULK_ROWS}"),
            say(op == "confirmable_overwrite", "a file that is there would be lost"),
            say(_known(op, HIGH), op, " can't be undone"),
            say(_known(op, MEDIUM), op, " writes something new"),
            say(unknown, "nothing is known of ", op),
            say(read_only, F.col("name"), " may only be read"),
            say(escaped, first_out, " lies outside of ", F.col("name")),
        )
    )
    level = F.when(read_only | escaped, "high").otherwise(base)
    return operations.withColumns({"level": level, "reasons": reasons, "tripped": tripped, "requires_confirmation": (level == "high") | tripped})


def gate(operations: DataFrame) -> DataFrame:
    """Adds outcome to what ``assess`` gives: refused, confirm or pass. Confirming doesn't lift a refusal."""
    asked = F.col("tripped") & ~F.coalesce("confirm", F.lit(False))
    return assess(operations).withColumn("outcome", F.when(F.col("level") == "high", "refused").when(asked, "confirm").otherwise("pass"))


def intercept(spark: SparkSession, operation: str, targets: list[str] | None = None, workspace: dict | None = None, row_count: int | None = None, confirm: bool = False) -> dict:
    """One operation at the gate: its level, reasons, outcome, and an error if it is refused."""
    ws = workspace or {}
    root = ws.get("root_path")
    paths = [normal_path(t, root) if root else t for t in targets or []]
    row = [(operation, paths, row_count, confirm, ws.get("name"), root, ws.get("policy"))]
    out = gate(spark.createDataFrame(row, "operation string, targets array<string>, row_count int, confirm boolean, name string, root_path string, policy string")).first().asDict()
    if out["outcome"] == "refused":
        out["error"] = f"refused: {operation} ({'; '.join(out['reasons'])})"
    return out


def append_audit(entries: DataFrame, path: str) -> None:
    """Adds entries to the trail; it is only ever appended to."""
    wanted = [f.split(" ")[0] for f in AUDIT.split(", ")]
    entries.select(*wanted).write.mode("append").parquet(path)


def recent_audit(trail: DataFrame, limit: int = 50) -> DataFrame:
    return trail.orderBy(F.desc("timestamp"), "id").limit(limit)


