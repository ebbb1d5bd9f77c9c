"""The command line: ``python -m corpuslens.cli --store DIR COMMAND ...``. A refused operation exits with 2."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corpuslens.engine import Engine
from corpuslens.operators import risk


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpuslens")
    top.add_argument("--store", required=True, help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)

    def command(called: str, /, *arguments: str, **options: dict) -> None:
        sub = commands.add_parser(called)
        for a in arguments:
            sub.add_argument(a)
        for o, kind in options.items():
            sub.add_argument("--" + o.replace("_", "-"), **kind)

    text, flag, many = {}, {"action": "store_true"}, {"action": "append", "default": []}
    number = {"type": int, "default": 20}
    command("status")
    command("workspace-add", "root", name=text, policy={"default": "read-only"}, vector=flag, ocr=flag)
    command("workspace-list")
    command("workspace-remove", "workspace")
    command("workspace-set", "workspace", policy=text, vector={"choices": ["on", "off"]})
    command("index", "workspace", force=flag, max_files={"type": int})
    command("search", "text", workspace=many, kind=many, limit=number, mode={"default": "hybrid"}, strict=flag)
    command("evidence", "intent", "text", workspace=many, max_sources={"type": int, "default": 8})
    command("text", "document")
    command("invoice-extract", "document", no_persist=flag)
    command("invoice-export", "workspace", "path", confirm=flag, overwrite=flag, no_extract=flag)
    command("client-history", "name", workspace=many, alias=many)
    command("contract-sections", "document", no_persist=flag)
    command("contract-diff", "first", "second")
    command("email-draft", "workspace", "recipient", "text", subject={"default": "Follow-up"}, intent={"default": "reply"}, language={"default": "auto"})
    command("review", "workspace", threshold={"type": float, "default": 0.7}, limit=number)
    command("summary", "workspace")
    command("audit", limit=number)
    command("risk", "operation", workspace=text, target=many, confirm=flag, rows={"type": int})
    return top


def run(spark: SparkSession, arguments: list[str]) -> tuple[Any, int]:
    """What a command answers, and its exit code."""
    a = parser().parse_args(arguments)
    engine = Engine(spark, a.store)
    match a.command:
        case "status":
            out = engine.status()
        case "workspace-add":
            out = {"workspace_id": engine.add_workspace(a.root, a.name, a.policy, enable_vector_search=a.vector, enable_ocr=a.ocr)}
        case "workspace-list":
            out = engine.workspaces()
        case "workspace-remove":
            out = engine.remove_workspace(a.workspace)
        case "workspace-set":
            values = {"policy": a.policy, "enable_vector_search": None if a.vector is None else a.vector == "on"}
            out = engine.update_workspace(a.workspace, **{k: v for k, v in values.items() if v is not None})
        case "index":
            out = engine.index(a.workspace, a.force, a.max_files)
        case "search":
            found = engine.search(a.text, a.workspace, a.kind, a.limit, a.mode, a.strict)
            out = found.select("document_id", "path", "score", "reason", "matched_terms")
        case "evidence":
            out = engine.evidence(a.intent, a.text, a.workspace, a.max_sources)
        case "text":
            out = {"text": engine.text_of(a.document)}
        case "invoice-extract":
            out = engine.extract_invoice(a.document, not a.no_persist)
        case "invoice-export":
            out = engine.invoice_table(a.workspace, a.path, a.confirm, a.overwrite, not a.no_extract)
        case "client-history":
            out = engine.client_history(a.name, a.workspace, a.alias)
        case "contract-sections":
            out = engine.contract_sections(a.document, not a.no_persist)
        case "contract-diff":
            out = engine.compare_contracts(a.first, a.second)
        case "email-draft":
            out = engine.email_draft(a.workspace, a.recipient, a.subject, a.intent, a.text, language=a.language)
        case "review":
            out = engine.low_confidence_review(a.workspace, a.threshold, a.limit)
        case "summary":
            out = engine.folder_summary(a.workspace)
        case "audit":
            out = engine.recent_audit(a.limit)
        case "risk":
            ws = engine.workspace(a.workspace) if a.workspace else None
            out = risk.intercept(spark, a.operation, a.target, ws, a.rows, a.confirm)
    if isinstance(out, DataFrame):
        out = [r.asDict(recursive=True) for r in out.collect()]  # what a person reads
    return out, 2 if isinstance(out, dict) and out.get("outcome") == "refused" else 0


def main() -> int:
    out, code = run(SparkSession.builder.appName("corpuslens").getOrCreate(), sys.argv[1:])
    print(json.dumps(out, default=str, ensure_ascii=False, indent=2), file=sys.stderr if code else sys.stdout)
    return code


if __name__ == "__main__":
    sys.exit(main())
