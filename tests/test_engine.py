"""Files to tables to answers, through the programming interface."""

import io
import time
import zipfile
from datetime import datetime, timezone

import pytest

from corpuslens import cli
from corpuslens.engine import Engine
from corpuslens.sources import extractors
from corpuslens.streaming import watch

NOW = datetime(2026, 5, 17, tzinfo=timezone.utc)


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = zipped(
    {
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="Q1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>Item</t></si><si><t>Price</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"/><row r="4"><c r="A4"><v>7</v></c></row></sheetData></worksheet>',
    }
)
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
PPTX = zipped({"ppt/slides/slide1.xml": f'<p:sld {A}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><p:txBody><a:p><a:r><a:t>Deck</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>Point</a:t></a:r></a:p></p:txBody></p:sp></p:sld>', "ppt/notesSlides/notesSlide1.xml": f'<p:notes {A}><p:sp><p:txBody><a:p><a:r><a:t>Say it</a:t></a:r></a:p></p:txBody></p:sp></p:notes>'})


def test_office_files():
    assert [(c["text"], c.get("section_heading")) for c in extractors.docx_text(DOCX)] == [("Title\nBody text", "Title"), ("A\tB", None)]
    assert [(c["text"], c["sheet_name"], c["cell_range"]) for c in extractors.xlsx_text(XLSX)] == [("Item\t\tPrice\n7", "Q1", "A2:C4")]
    assert [(c["text"], c["slide_number"]) for c in extractors.pptx_text(PPTX)] == [("Deck\nPoint\n[notes]\nSay it", 1)]
    table = "<a:tbl><a:tr><a:tc><a:t>H</a:t></a:tc><a:tc><a:t>I</a:t></a:tc></a:tr><a:tr><a:tc><a:t>1</a:t></a:tc><a:tc><a:t>2</a:t></a:tc></a:tr></a:tbl>"
    deck = zipped({"ppt/slides/slide1.xml": f"<p:sld {A}><p:graphicFrame>{table}</p:graphicFrame></p:sld>"})
    assert [(c["text"], c["chunk_kind"], c["confidence"], c["slide_number"]) for c in extractors.pptx_text(deck)] == [("H\tI\n1\t2", "table", 0.85, 1)]
    assert list(extractors.tables("pptx", deck)) == [{"headers": ["H", "I"], "rows": [["1", "2"]], "confidence": 0.85, "slide_number": 1}]
    assert list(extractors.tables("docx", DOCX)) == [{"headers": ["A", "B"], "rows": [], "confidence": 0.95}]
    assert list(extractors.tables("xlsx", XLSX)) == [{"headers": ["Item", "", "Price"], "rows": [["7"]], "confidence": 0.9, "sheet_name": "Q1", "cell_range": "A2:C4"}]
    assert [extractors.column_name(n) for n in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"]


def test_text_files():
    assert [(c["text"], c["section_heading"]) for c in extractors.plain_text(b"intro\n# One\nx\n## Two\ny", True)] == [("intro", None), ("# One\nx", "One"), ("## Two\ny", "Two")]
    long = "\n".join(["a" * 800, "b" * 800, "", "c"]).encode()
    assert [len(c["text"]) for c in extractors.plain_text(long)] == [1601, 1]
    rows = "h1,h2\n" + "\n".join(f"{i},x" for i in range(450))
    assert [c["cell_range"] for c in extractors.table_text(rows.encode(), ",")] == ["rows 2-201", "rows 202-401", "rows 402-451"]
    assert [c["text"] for c in extractors.table_text(b"only,head", ",")] == ["only,head"] and list(extractors.table_text(b"", ",")) == []
    assert [c["text"] for c in extractors.json_text(b'{"a":[1]}')] == ['{\n  "a": [\n    1\n  ]\n}'] and [c["text"] for c in extractors.json_text(b"{bad")] == ["{bad"]
    assert extractors.html_to_text("<p>a<script>x</script> <b>b</b></p><style>y</style>") == "a\nb"
    bad = extractors.extract_file("w", "/x.docx", "docx", b"junk", {})
    assert len(bad) == 1 and bad[0][3].startswith("BadZipFile") and extractors.extract_file("w", "/x.xml", "xml", b"<a/>", {})[0][3] == "RuntimeError: no extractor for xml"


@pytest.fixture()
def engine(spark, tmp_path):
    root = tmp_path / "ws"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / ".git" / "x.txt").write_text("hidden")
    (root / "invoice-1.md").write_text("# Invoice INV-2025-01\nTotal: $1,200.00\nBill To: Acme Inc\nmail a@acme.com")
    (root / "sub" / "b.csv").write_text("name,tel\nBob,090-1234-5678\n")
    (root / "c.docx").write_bytes(DOCX)
    (root / "bad.xlsx").write_bytes(b"junk")
    (root / "skip.bin").write_bytes(b"x")
    (root / "nda-v1.md").write_text("# 第1条 (期間)\n3 年間\n# 第2条 (法)\n日本法")
    (root / "nda-v2.md").write_text("# 第1条 (期間)\n5 年間\n# 第2条 (法)\n日本法")
    out = Engine(spark, f"file://{tmp_path}/store")
    out.ws = out.add_workspace(str(root), policy="full-write", enable_vector_search=True, now=NOW)
    out.root_path = root
    return out


def test_index_search_and_workflows(spark, engine):
    assert engine.index(engine.ws) == {"seen": 6, "indexed": 5, "skipped": 0, "errors": 1}
    assert engine.index(engine.ws)["indexed"] == 0
    docs = {r.name: r for r in engine.documents().collect()}
    assert docs.keys() == {"invoice-1.md", "b.csv", "c.docx", "bad.xlsx", "nda-v1.md", "nda-v2.md"}
    assert docs["bad.xlsx"].extraction_error and not docs["bad.xlsx"].has_extracted_text and docs["b.csv"].pii_flagged
    found = engine.search("acme invoice", [engine.ws], now=NOW).collect()
    assert found[0].name == "invoice-1.md" and "semantic" in found[0].reason and "entity ~ 'acme'" in found[0].reason
    for mode in ("fulltext", "filename", "entity", "semantic"):
        assert engine.search("acme invoice", [engine.ws], mode=mode, now=NOW).first().name == "invoice-1.md"
    packet = engine.evidence("pay the invoice", "acme invoice", [engine.ws], now=NOW).first()
    assert packet.sources[0].file_name == "invoice-1.md"
    assert engine.text_of(docs["b.csv"].path) == "name,tel\nBob,090-1234-5678"
    assert {r.key: r.value for r in engine.extract_invoice(docs["invoice-1.md"].path).collect()} == {"invoice_number": "INV-2025-01", "total": "$1,200.00", "recipient": "Acme Inc"}
    history = engine.client_history("Acme Inc.").collect()
    assert [(r.name, r.bucket, r.currency, r.amount) for r in history] == [("invoice-1.md", "invoice", "USD", 1200.0)]
    assert engine.contract_sections(docs["nda-v1.md"].document_id).count() == 2
    assert [r.status for r in engine.compare_contracts(docs["nda-v1.md"].path, docs["nda-v2.md"].path).orderBy("place").collect()] == ["substantive", "identical"]
    assert engine.low_confidence_review(engine.ws).first().item_count == 1
    assert {r.kind: r.documents for r in engine.folder_summary(engine.ws).collect()} == {"markdown": 3, "csv": 1, "docx": 1, "xlsx": 1}
    written = engine.invoice_table(engine.ws, "out/invoices.csv")
    assert written["outcome"] == "written" and written["rows"] == 1
    again = engine.invoice_table(engine.ws, "out/invoices.csv", overwrite=True)
    assert again["outcome"] == "confirm" and spark.read.text(again["difference"]).first().value.startswith("(no textual difference between invoices.csv and")
    assert engine.invoice_table(engine.ws, "out/invoices.csv", overwrite=True, confirm=True)["path"].endswith("out/invoices.csv")
    assert engine.invoice_table(engine.ws, "/elsewhere/x.csv")["outcome"] == "refused"
    draft = engine.email_draft(engine.ws, "a@acme.com", "Your invoice", "reply about the invoice", "acme invoice", now=NOW)
    assert "/drafts/2026-05-17-a-your-invoice-" in draft["path"] and draft["citations"] >= 1
    engine.audit("search", "test", now=NOW)
    assert {"extract", "search", "export_csv", "draft"} <= {r.operation for r in engine.recent_audit().collect()}
    assert packet.sources[0].locator == "" and engine.search("acme", [engine.ws], kinds=["odd"], now=NOW).count() > 0
    assert engine.status().filter("capability = 'text'").first().available


def test_changes_deletion_and_watch(spark, engine, tmp_path):
    engine.index(engine.ws)
    (engine.root_path / "new.txt").write_text("fresh words")
    (engine.root_path / "c.docx").unlink()
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = [(str(engine.root_path / "new.txt"), None, "created", False, 1), (str(engine.root_path / "c.docx"), None, "modified", False, 2), (str(engine.root_path / "c.docx"), None, "deleted", False, 3), (str(engine.root_path), None, "modified", True, 4)]
    spark.createDataFrame(rows, watch.EVENTS).write.mode("append").json(f"file://{feed}")
    stream = spark.readStream.schema(watch.EVENTS).json(f"file://{feed}")
    query = engine.start_watch(engine.ws, stream, f"file://{tmp_path}/state", once=True)
    assert engine.start_watch(engine.ws, stream, "unused") is query or not query.isActive
    query.awaitTermination()
    time.sleep(0.1)
    names = {r.name for r in engine.documents().collect()}
    assert "new.txt" in names and "c.docx" not in names
    assert engine.chunks().filter("text = 'fresh words'").count() == 1
    assert engine.watches.list()[0]["events_processed"] == 2 and engine.watches.stop(engine.ws)
    engine.apply_events, kept = lambda *_: 1 / 0, engine.apply_events
    failing = engine.start_watch(engine.ws, stream, f"file://{tmp_path}/state2", once=True)
    failing.awaitTermination()
    engine.apply_events = kept
    told = engine.recent_audit().filter("tool = 'watch' AND error LIKE 'ZeroDivisionError%'").collect()  # each path by itself
    assert failing.exception() is None and {r.referenced_files[0].rsplit("/", 1)[1] for r in told} == {"new.txt", "c.docx"} and len(told) == 2
    engine.watches.stop(engine.ws)
    engine.remove_workspace(engine.ws)
    assert engine.documents().count() == 0 and engine.chunks().count() == 0 and engine.workspaces().count() == 0


def test_command_line(spark, engine):
    store = engine.store.root
    call = lambda *a: cli.run(spark, ["--store", store, *a])
    assert call("index", engine.ws)[0]["indexed"] == 5
    found, code = call("search", "acme invoice", "--workspace", engine.ws)
    assert code == 0 and found[0]["path"].endswith("invoice-1.md")
    assert call("risk", "delete")[1] == 2 and call("risk", "read", "--workspace", engine.ws, "--target", "a.md")[1] == 0
    assert {r["kind"] for r in call("summary", engine.ws)[0]} == {"markdown", "csv", "docx", "xlsx"}
    call("workspace-set", engine.ws, "--vector", "off")
    assert call("workspace-list")[0][0]["enable_vector_search"] is False
    assert any(r["capability"] == "pdf" for r in call("status")[0])


def test_adding_a_workspace_again_keeps_its_id(engine):
    again = engine.add_workspace(str(engine.root_path), name="other", policy="read-only", now=NOW)
    assert again == engine.ws and engine.workspace(again)["name"] == "other"
    with pytest.raises(ValueError):
        engine.add_workspace("/x", policy="odd")
    with pytest.raises(KeyError):
        engine.workspace("ws_none")
