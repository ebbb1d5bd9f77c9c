"""The programming interface: workspaces, indexing, watching, search, evidence, workflows, gates, over one store."""

from __future__ import annotations

import posixpath
import uuid
from datetime import datetime, timezone
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import schema
from corpuslens.functions import embed
from corpuslens.operators import contracts, drafts, entities, history, invoices, pii, review, risk, vectors
from corpuslens.operators import search as ranking
from corpuslens.plans import store as st
from corpuslens.plans import understand
from corpuslens.sources import extractors, files, walk
from corpuslens.streaming import folder, watch

MODES = ("hybrid", "filename", "fulltext", "semantic", "entity")


def _now(now: datetime | None) -> datetime:
    return now or datetime.now(timezone.utc)


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: embed.Embedder | None = None):
        self.spark, self.store = spark, st.Store(spark, root)
        self.embedder = embedder or embed.hashing()
        self.watches = watch.Watches(spark)

    # ---- tables by the names that operators use

    def documents(self) -> DataFrame:
        return self.store.read("documents").withColumnRenamed("id", "document_id")

    def chunks(self) -> DataFrame:
        return self.store.read("chunks").withColumnRenamed("id", "chunk_id")

    def status(self) -> DataFrame:
        """Capabilities, whether they are there, and what serves them."""
        return self.spark.createDataFrame(extractors.capabilities(), "capability string, available boolean, served_by string")

    # ---- workspaces

    def add_workspace(self, root_path: str, name: str | None = None, policy: str = "read-only", now: datetime | None = None, **settings: Any) -> str:
        """The id of the workspace of a folder; adding it again changes its settings."""
        if policy not in schema.POLICIES:
            raise ValueError(f"policy must be one of {schema.POLICIES}")
        root_path = posixpath.normpath(root_path)
        known = self.store.read("workspaces").filter(F.col("root_path") == root_path).first()
        row = {
            "id": known.id if known else f"ws_{uuid.uuid4().hex[:12]}", "name": name or posixpath.basename(root_path), "root_path": root_path, "policy": policy,
            "status": known.status if known else "unindexed", "exclude_globs": list(files.DEFAULT_EXCLUDES), "include_extensions": None, "max_file_size_mb": 100,
            "enable_ocr": False, "enable_vector_search": False, "pii_warning": True, "created_at": known.created_at if known else _now(now),
            "last_indexed_at": known.last_indexed_at if known else None, "document_count": known.document_count if known else 0, "error": None,
        } | settings
        new = self.spark.createDataFrame([row], schema.WORKSPACES)
        self.store.update("workspaces", lambda old: st.upsert(old, new, "id"))
        self.audit("create", "add_workspace", referenced_files=[root_path], now=now)
        return row["id"]

    def workspaces(self) -> DataFrame:
        return self.store.read("workspaces").orderBy("created_at")

    def workspace(self, workspace_id: str) -> dict:
        row = self.store.read("workspaces").filter(F.col("id") == workspace_id).first()
        if row is None:
            raise KeyError(f"unknown workspace {workspace_id}")
        return row.asDict()

    def update_workspace(self, workspace_id: str, **values: Any) -> None:
        new = self.spark.createDataFrame([{"id": workspace_id} | values], schema.WORKSPACES)
        self.store.update("workspaces", lambda old: st.patch(old, new, "id"))

    def remove_workspace(self, workspace_id: str) -> None:
        self.watches.stop(workspace_id)
        self.store.delete_workspace(workspace_id)
        self.audit("delete", "remove_workspace", extra={"workspace": workspace_id})

    # ---- indexing

    def index(self, workspace_id: str, force: bool = False, max_files: int | None = None, paths: DataFrame | None = None, now: datetime | None = None) -> dict:
        """Reads new and changed files of a workspace: how many were seen, indexed, skipped, and failed."""
        ws, now = self.workspace(workspace_id), _now(now)
        self.update_workspace(workspace_id, status="indexing")
        found = files.discover(self.spark, ws["root_path"], workspace_id, ws["include_extensions"], tuple(ws["exclude_globs"] or ()), ws["max_file_size_mb"] << 20, paths)
        if max_files is not None:
            found = found.orderBy("path").limit(max_files)
        todo = files.changed(found, self.store.read("documents"), force or paths is not None).persist()
        extracted = files.extract(self.spark, todo, ws["root_path"], {"enable_ocr": ws["enable_ocr"]}).persist()
        documents, chunks = files.tables(todo, extracted, now)
        ids = documents.select(F.col("id").alias("document_id"))
        chunks_in = chunks.withColumnRenamed("id", "chunk_id")
        known = pii.flagged(chunks_in).select(F.col("document_id").alias("id"), F.lit(True).alias("pii_flagged"))
        documents = documents.join(known, "id", "left").withColumn("pii_flagged", F.coalesce("pii_flagged", F.lit(False)))
        body = F.concat_ws(" ", "text", "section_heading", "sheet_name")
        terms, lengths = ranking.postings(chunks_in.select("chunk_id", "workspace_id", "document_id", body.alias("body")), ("chunk_id", "workspace_id", "document_id"), "body")
        said = entities.extract(chunks_in)
        new = {"chunks": chunks, "entities": said, "grams": ranking.entity_grams(said), "postings": terms, "lengths": lengths}
        also, made = {}, None
        if ws["enable_vector_search"]:
            made = embed.embed(chunks_in, self.embedder).persist()
            new["vectors"], also = self._vectors(made)
        replace = {name: (lambda old, name=name, rows=rows: st.replace_children(old, self.store.typed(name, rows), ids)) for name, rows in new.items()}
        self.store.change(ids, replace | {"documents": lambda old: st.upsert(old, self.store.typed("documents", documents), "id")}, also)
        done = documents.agg(F.count("*").alias("n"), F.count_if(F.col("extraction_error").isNotNull()).alias("bad")).first()
        seen = found.count()
        todo.unpersist()
        if made is not None:
            made.unpersist()
        extracted.unpersist()
        self.audit("extract", "index", referenced_files=[ws["root_path"]], now=now)
        count = self.store.read("documents").filter(F.col("workspace_id") == workspace_id).count()
        self.update_workspace(workspace_id, status="indexed", last_indexed_at=now, document_count=count)
        return {"seen": seen, "indexed": done.n - done.bad, "skipped": seen - done.n, "errors": done.bad}

    def centres(self) -> np.ndarray:
        """Of the vector index; no rows before the first vector."""
        rows = self.store.read("centres").orderBy("cell").collect()  # vectors.CENTRES at most
        return np.array([r.centre for r in rows]) if rows else np.zeros((0, 0))

    def _vectors(self, made: DataFrame) -> tuple[DataFrame, dict]:
        """New vectors with their places in the index; the first ones, and those of another dimension than the index has, begin a new one."""
        centres = self.centres()
        sized = made.filter(F.col("embedding").isNotNull()).select(F.size("embedding").alias("dim")).first()
        if sized is None or (len(centres) and centres.shape[1] == sized.dim):
            return (vectors.placed(made, centres) if len(centres) else made), {}
        centres = vectors.fit(made)
        rows = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], schema.CENTRES)
        return vectors.placed(made, centres), {"centres": lambda _: rows}

    def rebuild_vectors(self) -> int:
        """Fits the index anew on all vectors there are, and drops those of another dimension than most have; how many lists it has then. For
        when a workspace has grown, or another embedder has read it."""
        base = self.store._state()
        old = self.store.read("vectors", state=base[1]).drop("cell", "away")
        centres = vectors.fit(old)
        rows = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], schema.CENTRES)
        kept = st.fitting_vectors(old, centres.shape[1]) if len(centres) else old
        self.store.commit({"vectors": vectors.placed(kept, centres) if len(centres) else kept, "centres": rows}, base=base)
        return len(centres)

    def apply_events(self, workspace_id: str, events: DataFrame) -> None:
        """Acts on (path, event_type): deletes what was deleted, reads again what else was touched and is still there."""
        gone = events.filter(F.col("event_type") == "deleted").select(schema.document_id(F.lit(workspace_id), F.col("path")).alias("document_id"))
        self.store.delete_documents(gone)
        touched = events.filter(F.col("event_type") != "deleted").select("path")
        if not touched.isEmpty():
            self.index(workspace_id, paths=touched)

    def start_watch(self, workspace_id: str, events: DataFrame | None = None, checkpoint: str | None = None, once: bool = False, step: str = watch.STEP):  # noqa: ANN201
        """Acts on what happens to a workspace's files until stopped: on the events that its folder's listings give, or on a stream of
        them. A step that fails is done again in halves, so that only the paths that can't be worked off are left, and told in the
        trail; the next ``index`` finds them. Without ``checkpoint``, a watch that starts again finds what changed meanwhile by the store's own folder."""
        ws = self.workspace(workspace_id)
        if events is None:
            at = walk.rooted(self.spark, ws["root_path"])
            if at is None:
                raise ValueError(f"no listing of {ws['root_path']} in tasks; give a stream of events")
            events = folder.folder_events(self.spark, at, tuple(ws["exclude_globs"] or ()))

        def act(batch: DataFrame, _: int) -> None:
            batch.persist()
            try:
                watch.in_halves(batch, lambda part: self.apply_events(workspace_id, part), lambda n: self.watches.count(workspace_id, n), self._failed)
            finally:
                batch.unpersist()

        self.audit("index", "start_watch", referenced_files=[ws["root_path"]])
        checkpoint = checkpoint or f"{self.store.root}/_watches/{workspace_id}"
        return self.watches.start(workspace_id, lambda: watch.watch(events, act, checkpoint, f"watch-{workspace_id}", step, once))

    def _failed(self, path: str, error: Exception) -> None:
        self.audit("extract", "watch", referenced_files=[path], error=f"{type(error).__name__}: {error}"[:2000])

    # ---- search

    def search(self, text: str, workspace_ids: list[str] | None = None, kinds: list[str] | None = None, limit: int = 20, mode: str = "hybrid", strict: bool = False, now: datetime | None = None, calendar: bool = False) -> DataFrame:
        """Documents by score, each with its best chunk. ``kinds`` filters the full-text list, with ``strict`` every list."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        now = _now(now)
        asked = understand.parse(text, now, calendar)
        docs, chunks = self.documents(), self.chunks()
        kinds = [k for k in kinds or [] if k in schema.KIND_BY_EXTENSION.values()]  # unknown ones don't count
        if workspace_ids:
            docs = docs.filter(F.col("workspace_id").isin(*workspace_ids))
        if strict and kinds:
            docs = docs.filter(F.col("kind").isin(*kinds))
        listed = docs.filter(F.col("kind").isin(*kinds)) if kinds else docs
        own = chunks.join(docs.select("document_id"), "document_id", "left_semi")
        known = None if mode in ("filename", "fulltext", "semantic") else ranking.entity_documents_indexed(self.store.read("grams"), text, docs.select("document_id"))
        fetch = ranking.over_fetch(limit)
        hits = ranking.bm25_indexed(self.store.read("postings"), self.store.read("lengths"), text, "chunk_id", "document_id")
        hits = hits.join(listed.select("document_id"), "document_id", "left_semi").orderBy(F.desc("score"), "chunk_id").limit(fetch)
        near = None
        if mode in ("hybrid", "semantic") and text.strip() and workspace_ids and self.workspaces().filter(F.col("id").isin(*workspace_ids) & F.col("enable_vector_search")).count():
            goal = self.embedder([text])[0]
            index = self.store.read("vectors")
            near = vectors.nearest(index, self.centres(), vectors.lists(index), goal, fetch, where=F.col("workspace_id").isin(*workspace_ids))
        if mode in ("filename", "semantic", "entity"):
            hits = hits.filter("false")
        rows = ranking.candidates(docs, own, hits, known, near)
        if mode == "filename" or rows.isEmpty():
            first = docs if not workspace_ids else docs.filter(F.col("workspace_id") == workspace_ids[0])
            rows = ranking.by_file_name(first.orderBy(F.desc("mtime"), "document_id").limit(500) if mode != "filename" else docs, text)
        ranked = ranking.rank(rows, text, now, period=(asked.since, asked.until), period_note=asked.period_note)
        return ranked.orderBy(F.desc("score"), "document_id").limit(limit)

    def text_of(self, reference: str, max_chars: int = 20_000) -> str:
        """The text of a document, by id or path, as many whole chunks as fit."""
        doc = self.resolve(reference)
        rows = ranking.within_budget(self.chunks().filter(F.col("document_id") == doc), max_chars).orderBy("ordinal").select("text").collect()  # of max_chars at most
        return "\n\n".join(r.text for r in rows)

    def resolve(self, reference: str) -> str:
        hit = self.documents().filter((F.col("document_id") == reference) | (F.col("path") == reference)).orderBy(F.col("document_id") != reference, "document_id").first()
        if hit is None:
            raise KeyError(f"unknown document {reference}")
        return hit.document_id

    def evidence(self, intent: str, text: str, workspace_ids: list[str] | None = None, max_sources: int = ranking.MAX_SOURCES, now: datetime | None = None) -> DataFrame:
        """One row: a packet for an intent."""
        found = self.search(text, workspace_ids, limit=max(2 * max_sources, 16), now=now)
        firsts = self.chunks().groupBy("document_id").agg(F.min_by("chunk_id", "ordinal").alias("first_chunk"))
        more = self.documents().select("document_id", "workspace_id", F.col("extraction_method").alias("document_method"))
        place = schema.locator(F.col("page_number"), F.col("sheet_name"), F.col("cell_range"), F.col("slide_number"))
        places = self.chunks().select(F.col("chunk_id").alias("shown"), F.col("text").alias("chunk_text"), "confidence", "extraction_method", place.alias("locator"))
        rows = found.join(firsts, "document_id", "left").join(more, "document_id").withColumn("shown", F.coalesce("chunk_id", "first_chunk")).join(places, "shown", "left")
        rows = rows.select(
            "document_id", "workspace_id", "name", "path", "kind", "chunk_id", F.coalesce("chunk_text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
            F.coalesce("extraction_method", "document_method", F.lit("")).alias("extraction_method"), "score", "reason", "locator",
        )
        self.audit("search", "evidence", user_request=intent, now=now)
        return ranking.packet(ranking.evidence(rows, self.store.read("fields"), intent, max_sources), intent)

    # ---- workflows

    def extract_invoice(self, reference: str, persist: bool = True) -> DataFrame:
        """The best fields of one document."""
        doc = self.resolve(reference)
        best = invoices.best_fields(invoices.extract(self.chunks().filter(F.col("document_id") == doc)))
        if persist:
            self.audit("extract", "extract_invoice", referenced_files=[doc])
            ids = self.spark.createDataFrame([(doc,)], "document_id string")
            kept = self.store.read("fields").filter(F.col("key").startswith("section.") & (F.col("document_id") == doc))
            self.store.change(ids, {"fields": lambda old: st.replace_children(old, self.store.typed("fields", best).unionByName(kept), ids)})
        return best

    def invoice_table(self, workspace_id: str, path: str, confirm: bool = False, overwrite: bool = False, extract: bool = True) -> dict:
        """Writes the table of a workspace's invoices as CSV, behind the gates; a preview if many rows need a confirmation."""
        ws = self.workspace(workspace_id)
        target = risk.normal_path(path, ws["root_path"])
        gate = risk.intercept(self.spark, "export_csv", [target], ws)
        if gate["outcome"] == "refused":
            return gate
        docs = self.documents().filter((F.col("workspace_id") == workspace_id) & F.col("kind").isin(*invoices.INVOICE_KINDS))
        fields = self.store.read("fields").join(docs.select("document_id"), "document_id", "left_semi")
        if extract:
            own = self.chunks().join(docs.select("document_id"), "document_id", "left_semi")
            fields = invoices.best_fields(invoices.extract(own))
        rows = invoices.table(fields, docs).persist()
        n = rows.count()
        gate = risk.intercept(self.spark, "bulk_modify", [target], ws, row_count=n, confirm=confirm)
        if gate["outcome"] != "pass":
            if gate["outcome"] == "confirm":
                gate["preview"] = invoices.write_preview(rows, target)
            rows.unpersist()
            return gate | {"rows": n}
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        if there and not overwrite:
            target = f"{target.removesuffix('.csv')}-{datetime.now(timezone.utc):%Y%m%d-%H%M%S}.csv"
        elif there:
            gate = risk.intercept(self.spark, "confirmable_overwrite", [target], ws, confirm=confirm)
            if gate["outcome"] != "pass":
                if gate["outcome"] == "confirm":
                    gate["difference"] = invoices.write_difference(rows, target)
                rows.unpersist()
                return gate | {"rows": n}
        invoices.write_csv(rows, target)
        self.audit("export_csv", "invoice_table", "medium", output_files=[target])
        low = invoices.low_rows(rows).count()
        rows.unpersist()
        return {"outcome": "written", "path": target, "rows": n, "low_confidence": low}

    def client_history(self, name: str, workspace_ids: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
        docs = self.documents()
        if workspace_ids:
            docs = docs.filter(F.col("workspace_id").isin(*workspace_ids))
        self.audit("search", "client_history", user_request=name)
        return history.history(docs, self.store.read("entities"), self.store.read("fields"), history.aliases(name, extra))

    def client_histories(self, clients: DataFrame, workspace_ids: list[str] | None = None) -> DataFrame:
        """The histories of many clients (client_id, name, perhaps extra), with client_id."""
        docs = self.documents()
        if workspace_ids:
            docs = docs.filter(F.col("workspace_id").isin(*workspace_ids))
        self.audit("search", "client_histories")
        return history.histories(docs, self.store.read("grams"), self.store.read("fields"), clients)

    def contract_sections(self, reference: str, persist: bool = True) -> DataFrame:
        doc = self.resolve(reference)
        self.audit("extract", "contract_sections", referenced_files=[doc])
        cut = contracts.sections(contracts.stitch(self.chunks().filter(F.col("document_id") == doc)), contracts.LONGEST_BODY)
        if persist:
            ids = self.spark.createDataFrame([(doc,)], "document_id string")
            self.store.change(ids, {"fields": lambda old: st.replace_prefix(old, self.store.typed("fields", contracts.as_fields(cut)), ids, "section.")})
        return cut

    def compare_contracts(self, first: str, second: str) -> DataFrame:
        self.audit("compare", "compare_contracts", referenced_files=[first, second])
        a, b = (contracts.sections(contracts.stitch(self.chunks().filter(F.col("document_id") == self.resolve(r)))).withColumn("pair_id", F.lit("pair")) for r in (first, second))
        return contracts.compare(a, b)

    def low_confidence_review(self, workspace_id: str, threshold: float = review.THRESHOLD, limit: int = review.LIMIT) -> DataFrame:
        docs = self.documents().filter(F.col("workspace_id") == workspace_id)
        self.audit("review", "low_confidence_review", extra={"workspace": workspace_id})
        return review.grouped(review.low_confidence(self.store.read("fields"), docs, threshold, limit))

    def folder_summary(self, workspace_id: str) -> DataFrame:
        return review.folder_summary(self.documents().filter(F.col("workspace_id") == workspace_id))

    def email_draft(self, workspace_id: str, recipient: str, subject: str, intent: str, text: str, now: datetime | None = None, **more: Any) -> dict:
        """A draft from evidence, as a file under the workspace's ``drafts``; refused outside of it."""
        now, ws = _now(now), self.workspace(workspace_id)
        target = f"{ws['root_path']}/drafts/{drafts.file_name(recipient, subject, now)}"
        gate = risk.intercept(self.spark, "draft", [target], ws)
        if gate["outcome"] == "refused":
            return gate
        packet = self.evidence(intent, text, [workspace_id], now=now).first().asDict(recursive=True)
        out = drafts.draft(packet, recipient, subject, intent, now, workspace_id=workspace_id, **more)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        stream = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
        stream.write(bytearray(out["body"].encode()))
        stream.close()
        self.audit("draft", "email_draft", user_request=intent, output_files=[target], now=now)
        return out | {"path": target}

    def vector_count(self, workspace_id: str | None = None) -> int:
        """How many chunks have a vector, of one workspace or of all."""
        rows = self.store.read("vectors").filter(F.col("embedding").isNotNull())
        return (rows if workspace_id is None else rows.filter(F.col("workspace_id") == workspace_id)).count()

    # ---- trail

    def audit(self, operation: str, tool: str, risk_level: str = "low", now: datetime | None = None, **more: Any) -> None:
        """Adds an entry. Never raises: the trail must not stop the work it records."""
        try:
            row = {"id": f"log_{uuid.uuid4().hex[:12]}", "timestamp": _now(now), "actor": "user", "operation": operation, "tool": tool, "risk": risk_level} | more
            self.store.append("audit_log", self.spark.createDataFrame([row], schema.AUDIT))
        except Exception:  # noqa: BLE001
            pass

    def recent_audit(self, limit: int = 50) -> DataFrame:
        return risk.recent_audit(self.store.read("audit_log"), limit)
