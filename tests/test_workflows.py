import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import money
from corpuslens.functions import text as T
from corpuslens.operators import contracts, drafts, entities, history, invoices, pii, review, risk, search

NOW = datetime(2026, 5, 17, tzinfo=timezone.utc)


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").withColumn("_k", F.monotonically_increasing_id())
    return [r.x for r in df.select("_k", expression(F.col("v")).alias("x")).orderBy("_k").collect()]


def test_amounts(spark):
    texts = ["¥748,000", "$7,403.50", "€500", "USD 1,200.50", "12,000 円", "100 万円", "1.5億円", "1200", "", None, "£3", "¥120000"]
    want = [("JPY", 748000), ("USD", 7403.5), ("EUR", 500), ("USD", 1200.5), ("JPY", 12000), ("JPY", 1e6), ("JPY", 1.5e8), None, None, None, ("GBP", 3), ("JPY", 120000)]
    assert [tuple(x) if x else None for x in one(spark, texts, money.parse_amount)] == want
    assert tuple(one(spark, ["¥120000"], lambda c: money.parse_amount(c, legacy=True))[0]) == ("JPY", 120)


def test_text_functions(spark):
    assert one(spark, ["Taro.Y@example.com", "Acme, Inc.", "請求"], T.slug) == ["taro-y", "acme-inc", "x"]
    assert one(spark, ["a\r\nb\x0bc\n", "", None], T.lines) == [["a", "b", "c"], [], []]
    assert one(spark, ["  x \n\n y", None], T.normal_body) == ["x\ny", ""]
    assert one(spark, ["hello", "請求"], T.language) == ["en", "ja"]
    assert one(spark, ["\n  first  \nsecond", None], T.first_line) == ["first", ""]


ENTITIES = [
    ("total ¥1,200 due", "money", "¥1,200"), ("計 12,000 円", "money", "12,000 円"), ("on 2025-04-30", "date", "2025-04-30"), ("a.b@example.co.jp", "email", "a.b@example.co.jp"),
    ("call 03-1234-5678", "phone", "03-1234-5678"), ("see https://example.com/x", "url", "https://example.com/x"), ("株式会社ACME の", "org", "株式会社ACME"), ("Acme Widgets Inc", "org", "Acme Widgets Inc"),
]


def test_entities(spark):
    chunks = spark.createDataFrame([(str(k), str(k), t) for k, (t, _, _) in enumerate(ENTITIES)] + [("n", "n", None), ("r", "r", "A@b.de a@b.de a@b.de")], "document_id string, chunk_id string, text string")
    got = {}
    for r in entities.extract(chunks).collect():
        got.setdefault(r.document_id, set()).add((r.kind, r.text))
    for k, (_, kind, value) in enumerate(ENTITIES):
        assert (kind, value) in got[str(k)]
    assert "n" not in got and got["r"] == {("email", "A@b.de")}
    many = spark.createDataFrame([("d", "c", " ".join(f"u{i}@x.de" for i in range(60)))], "document_id string, chunk_id string, text string")
    assert entities.extract(many).filter("kind = 'email'").count() == 50


PII = [
    ("マイナンバー 123456789012", [("mynumber", "123456789012")]), ("123456789012", []), ("法人番号 123456789012", []), ("card 4111 1111 1111 1111 ok", [("credit_card", "4111 1111 1111 1111")]),
    ("0000000000000000", []), ("4111111111111112", []), ("INV 4111111111111111", []), ("tel 090-1234-5678", [("phone", "090-1234-5678")]), ("03-1234-5678", [("phone", "03-1234-5678")]),
    ("+81-3-1234-5678", [("phone", "+81-3-1234-5678")]), ("123-4567", []), ("", []), (None, []),
]


@pytest.mark.parametrize("text, want", PII)
def test_personal_data(text, want):
    assert [(h.kind, h.value) for h in pii.scan_text(text)] == want


def test_personal_data_as_rows(spark):
    docs = spark.createDataFrame([(str(k), t) for k, (t, _) in enumerate(PII)], "document_id string, text string")
    assert {(int(r.document_id), r.kind, r.value) for r in pii.scan(docs).collect()} == {(k, *h) for k, (_, w) in enumerate(PII) for h in w}
    hit = pii.scan_text("x" * 20 + "\n4111111111111111" + "y" * 20)[0]
    assert hit.evidence == "…" + "x" * 11 + " 4111111111111111" + "y" * 12 + "…"


INVOICES = {
    "heading": ("# 請求書\n## 請求番号\nINV-2025-001\n## 請求日\n2025/03/15\n## 合計\n\n¥748,000", {"invoice_number": ("INV-2025-001", 0.75), "issue_date": ("2025/03/15", 0.75), "total": ("¥748,000", 0.75)}),
    "inline": ("請求番号: INV-7\n合計 ¥1,000\n小計: ¥900", {"invoice_number": ("INV-7", 0.95), "total": ("¥1,000", 0.95), "subtotal": ("¥900", 0.95)}),
    "english": ("Invoice No.: INV-9\nSubtotal: $90.00\nTotal: $99.00\nBill To: Acme", {"invoice_number": ("INV-9", 0.95), "subtotal": ("$90.00", 0.95), "total": ("$99.00", 0.95), "recipient": ("Acme", 0.95)}),
    "title": ("# Invoice INV-2025-03", {"invoice_number": ("INV-2025-03", 0.65)}),
    "prose": ("The total of it all was nice.", {}),
    "null": (None, {}),
}


def test_invoice_fields(spark):
    chunks = spark.createDataFrame([(k, k, t) for k, (t, _) in INVOICES.items()], "document_id string, chunk_id string, text string")
    got = {}
    for r in invoices.extract(chunks).collect():
        got.setdefault(r.document_id, {})[r.key] = (r.value, r.confidence)
    assert got == {k: w for k, (_, w) in INVOICES.items() if w}


def test_invoice_table(spark):
    fields = spark.createDataFrame(
        [("a", "c1", "invoice_number", "INV-1", "id", 0.65, "x"), ("a", "c2", "invoice_number", "INV-2", "id", 0.95, "x"), ("a", "c2", "total", "¥1,000", "amount", 0.75, "x"), ("b", "c", "total", "$5", "amount", 0.9, "x")],
        "document_id string, chunk_id string, key string, value string, value_type string, confidence double, extractor string",
    )
    docs = spark.createDataFrame([("a", "/w/a.md", "markdown"), ("b", "/w/b.md", "markdown"), ("c", "/w/c.txt", "txt")], "document_id string, path string, kind string")
    best = invoices.best_fields(fields)
    row = invoices.table(best, docs).collect()
    assert len(row) == 1 and row[0].invoice_number == "INV-2" and row[0].currency == "JPY" and row[0].confidence_avg == "0.850" and row[0].tax == ""
    assert [r.document_id for r in invoices.skipped(docs, best).collect()] == ["b"]
    assert {r.document_id: (r.avg_confidence, r.low_confidence) for r in invoices.summary(best).collect()} == {"a": (0.85, []), "b": (0.9, [])}


def test_aliases():
    assert history.aliases("Acme Inc.") == ["Acme Inc.", "Acme"]
    assert history.aliases("株式会社ACME") == ["株式会社ACME", "ACME"]
    assert history.aliases("taro@example.com") == ["taro@example.com", "taro", "example.com", "example"]
    assert history.aliases("acme.co.jp", ["ACME", "x"]) == ["acme.co.jp", "acme"]


def test_client_history(spark):
    docs = spark.createDataFrame(
        [("1", "a.md", "/w/a.md", "markdown", NOW), ("2", "acme-nda.pdf", "/w/acme-nda.pdf", "pdf", NOW), ("3", "mail.txt", "/w/mail.txt", "txt", NOW), ("4", "z.txt", "/w/z.txt", "txt", NOW)],
        "document_id string, name string, path string, kind string, mtime timestamp",
    )
    known = spark.createDataFrame([("1", "ACME Inc"), ("3", "acme")], "document_id string, text string")
    fields = spark.createDataFrame([("1", "invoice_number", "INV-1", 0.9), ("1", "total", "¥10,000", 0.9)], "document_id string, key string, value string, confidence double")
    rows = history.history(docs, known, fields, history.aliases("Acme Inc."))
    assert {r.document_id: (r.bucket, r.via, r.currency, r.amount) for r in rows.collect()} == {"1": ("invoice", "entity", "JPY", 10000.0), "2": ("contract", "filename", None, None), "3": ("email", "entity", None, None)}
    assert history.recall(docs, known, []).count() == 0


CONTRACT = "Preamble text.\n\n# 第1条 (定義)\n本契約において。\n第2条【期間】\n3 年間とする。\nSection 3: Fees\nPay 100.\n4) Rest\nMore.\n第5条に定める。これは文です。\n"


def test_sections(spark):
    texts = spark.createDataFrame([("a", CONTRACT), ("b", "no clauses"), ("c", None)], "document_id string, text string")
    cut = contracts.sections(texts)
    got = [(r.ordinal, r.title, r.body) for r in cut.orderBy("position").collect()]
    assert got == [(1, "定義", "本契約において。"), (2, "期間", "3 年間とする。"), (3, "Fees", "Pay 100."), (4, "Rest", "More.\n第5条に定める。これは文です。")]
    assert [CONTRACT[r.char_offset :].startswith(h) for r, h in zip(cut.orderBy("position").collect(), ("# 第1条", "第2条", "Section 3", "4)"))] == [True] * 4
    assert {r.document_id: r.preamble for r in contracts.preamble(texts, cut).collect()} == {"a": "Preamble text.", "b": "no clauses", "c": None}
    assert contracts.as_fields(cut).count() == 12


def test_compare(spark):
    def version(rows):
        return spark.createDataFrame([("p", k, *r) for k, r in enumerate(rows)], "pair_id string, position int, ordinal int, title string, body string")

    a = version([(1, "Term", "for 3 years"), (2, "Law", "law of here"), (3, "Fees", "pay now please, without any delay at all"), (4, "Qqq", "bye"), (5, "Moved", "same text")])
    b = version([(1, "Term", "for 5 years"), (2, "Law", "law of here \n"), (3, "Fees", "pay now please, without any delays at all"), (6, "Moved", "same text"), (7, "zzz", "new")])
    got = contracts.compare(a, b)
    assert [(r.ordinal_a, r.ordinal_b, r.status) for r in got.orderBy("place").collect()] == [
        (1, 1, "substantive"), (2, 2, "identical"), (3, 3, "wording"), (5, 6, "identical"), (4, None, "removed"), (None, 7, "added"),
    ]
    row = contracts.difference_summary(got).first()
    assert (row.identical, row.wording, row.substantive, row.added, row.removed) == (2, 1, 1, 1, 1)
    assert contracts.hunks("a\nb", "a\nc")[0].startswith("@@") and contracts.hunks("a", "a") == []


def test_review(spark):
    fields = spark.createDataFrame([("d", "total", "1", 0.5), ("d", "tax", "2", 0.69), ("d", "section.1.title", "x", 0.1), ("gone", "total", "3", 0.2), ("d", "due", "4", 0.7)], "document_id string, key string, value string, confidence double")
    docs = spark.createDataFrame([("d", "/w/d", "d")], "document_id string, path string, name string")
    assert [(r.key, r.confidence) for r in review.low_confidence(fields, docs).collect()] == [("total", 0.5), ("tax", 0.69)]
    total = review.totals(fields, docs, limit=1).first()
    assert (total["items"], total.truncated) == (1, True)
    assert review.grouped(review.low_confidence(fields, docs)).first().item_count == 2
    with pytest.raises(ValueError):
        review.low_confidence(fields, docs, threshold=0)


WS = {"name": "w", "root_path": "/ws/w", "policy": "full-write"}
RISKS = [
    ("search", {}, None, "pass", "low"), ("copy", {}, None, "pass", "medium"), ("delete", {}, None, "refused", "high"), ("odd", {}, None, "pass", "medium"),
    ("bulk_modify", {"row_count": 5}, WS, "pass", "medium"), ("bulk_modify", {"row_count": 6}, WS, "confirm", "medium"), ("bulk_modify", {"row_count": 6, "confirm": True}, WS, "pass", "medium"),
    ("confirmable_overwrite", {}, WS, "confirm", "medium"), ("copy", {}, WS | {"policy": "read-only"}, "refused", "high"), ("read", {}, WS | {"policy": "read-only"}, "pass", "low"),
    ("read", {"targets": ["../x"]}, WS, "refused", "high"), ("read", {"targets": ["a/../b"]}, WS, "pass", "low"), ("delete", {"confirm": True}, WS, "refused", "high"),
]


@pytest.mark.parametrize("op, more, ws, outcome, level", RISKS)
def test_gates(spark, op, more, ws, outcome, level):
    got = risk.intercept(spark, op, workspace=ws, **more)
    assert (got["outcome"], got["level"]) == (outcome, level)
    assert ("error" in got) == (outcome == "refused")


def test_draft():
    source = {"file_path": "/w/a.pdf", "file_name": "a.pdf", "file_type": "pdf", "extracted_text": "\nHello 090-1234-5678", "locator": "p.2", "relevance_score": 1.0, "confidence_score": 0.9, "fields": [{"key": "total", "value": "¥1"}, {"key": "total", "value": "¥1"}, {"key": "tax", "value": "¥2"}]}
    out = drafts.draft({"sources": [source], "low_confidence_items": ["b"]}, "taro@x.jp", "Hi there", "reply", NOW)
    assert out["language"] == "en" and out["citations"] == 1 and out["checklist"] == 3 + 1 + 1 + 2
    assert "- `/w/a.pdf` (p.2) — Hello 090-1234-5678" in out["body"] and [h.kind for h in out["pii"]] == ["phone"]
    assert drafts.draft({}, "a", "b", "返信", NOW)["language"] == "ja"
    assert drafts.file_name("taro@x.jp", "Hi there", NOW) == "2026-05-17-taro-hi-there-000000.md"
    assert "1. **a.pdf** (pdf) p.2" in drafts.packet_markdown({"sources": [source], "intent": "x"})


def test_digits_of_any_script(spark):
    import re

    wide = str.maketrans("0123456789", "０１２３４５６７８９")
    texts = [t.translate(wide) for t in ("個人番号 123456789012 です", "card 4111 1111 1111 1111 ok", "only 12 and 34")]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    got = [(r.document_id, *tuple(r)[1:]) for r in pii.scan(df).orderBy("document_id", "start").collect()]
    assert got == [(i, *h) for i, t in enumerate(texts) for h in pii.scan_text(t)] and {g[0] for g in got} == {0, 1}
    said = [t.translate(wide) for t in ("2024年5月3日 に 1,200円", "2024-05-03 total USD 120.50", "¥ 300")]
    chunks = spark.createDataFrame([(k, k, t) for k, t in enumerate(said)], "document_id long, chunk_id long, text string")
    found = {(r.document_id, r.kind, r.text) for r in entities.extract(chunks, kinds=("money", "date")).collect()}
    want = set()
    for kind, _, pattern in entities.PATTERNS[:2]:
        flags = re.IGNORECASE if "(?i" in pattern else 0
        want |= {(k, kind, m[0].strip(" ")) for k, t in enumerate(said) for m in re.finditer(re.sub(r"^\(\?i?U\)", "", pattern), t, flags)}
    assert found == want and len(want) >= 5


def test_entities_of_a_text_with_very_many_matches(spark):
    text = " ".join(f"Name{i}@Host{i % 7}.com" for i in range(100_000)) + " NAME1@HOST1.COM name2@host2.com"
    df = spark.createDataFrame([("d", "c", text), ("d", "c2", None)], "document_id string, chunk_id string, text string")
    began = time.time()
    got = entities.extract(df, most=10**6, kinds=("email",)).agg(F.count("*").alias("n"), F.countDistinct(F.lower("text")).alias("distinct"), F.count_if(F.col("text").startswith("Name"))).first()
    assert tuple(got) == (100_000, 100_000, 100_000) and time.time() - began < 30
    assert [r.text for r in entities.extract(df, most=3, kinds=("email",)).collect()] == ["Name0@Host0.com", "Name1@Host1.com", "Name2@Host2.com"]


@pytest.mark.parametrize("per", [1, 40])
def test_clauses_of_a_contract_with_very_many_lines(spark, per):
    n = 20_000
    lines = [f"Section {i // per}: Title {i}" if i % per == 0 else f"  line {i} of a body é" for i in range(n)]
    text = "Preamble\n" + "\r\n".join(lines)
    df = spark.createDataFrame([("a", text), ("a", text), ("b", "no clause\nat all"), ("c", None)], "document_id string, text string")
    began = time.time()
    got = contracts.sections(df).orderBy("position").collect()
    assert time.time() - began < 40 and len(got) == 2 * n // per
    for k, r in enumerate(got):
        i = k // 2 * per
        assert (r.document_id, r.position, r.ordinal, r.title) == ("a", k // 2, k // 2, f"Title {i}") and text[r.char_offset :].startswith(r.heading)
        assert r.body == "\r\n".join(lines[i + 1 : i + per]).strip()
    assert [r.body for r in contracts.sections(df.filter("document_id = 'b'")).collect()] == []


def test_histories_of_many_clients_are_those_one_by_one(spark):
    names = ["株式会社Acme", "Acme Ltd.", "buyer@acme.co.jp", "AB", "b c", "x", "", None, "Ünï GmbH", "Zed Inc.", "acme", "nobody at all"]
    clients = spark.createDataFrame([(k, n, ["ACM", " "] if k == 9 else None) for k, n in enumerate(names)], "client_id int, name string, extra array<string>")
    texts = ["acme k.k.", "ACME", "Blue ünï", "zed", "ab", "cab c", "buyer", "acme.co.jp", "x", "", None, "株式会社 Acme", "acm"]
    known = spark.createDataFrame([(f"d{k % 8}", t) for k, t in enumerate(texts)], "document_id string, text string")
    docs = spark.createDataFrame([(f"d{k}", f"{n}.pdf", f"/f/{n}.pdf", "pdf", NOW) for k, n in enumerate(["acme invoice", "q", "請求書", "ab", "zed-nda", "ünï", "w", "w2", "buyer", "b c"])], "document_id string, name string, path string, kind string, mtime timestamp")
    fields = spark.createDataFrame([("d0", "total", "¥1,000", 0.9), ("d0", "invoice_number", "7", 0.9)], "document_id string, key string, value string, confidence double")
    got = history.histories(docs, search.entity_grams(known), fields, clients).collect()
    want = set()
    for k, name in enumerate(names):
        spelled = history.aliases(name, ["ACM", " "] if k == 9 else None)
        want |= {(k, *r) for r in history.history(docs, known, fields, spelled).collect()}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 15
    assert history.histories(docs, search.entity_grams(known), fields, clients.filter("false")).count() == 0


def test_aliases_of_many_clients_are_joined_by_equality(spark):
    """No alias is set against a list of texts, which would be quadratic; parts that begin alike, overlap or repeat in a text are all found."""
    names = ["aaa", "aaaa", "aab", "ab", "b, Inc.", "xaab", "Zed@aaab.com"]
    texts = ["aaaab", "xaaabaaab", "ab", "b", "AAAA", "zed", ""]
    docs = spark.createDataFrame([(f"d{k}", f"/p/{t}.md", f"{t}.md", "markdown") for k, t in enumerate(texts)], "document_id string, path string, name string, kind string")
    known = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts[::-1])], "document_id string, text string")
    clients = spark.createDataFrame(list(enumerate(names)), "client_id int, name string")
    found = history.recall_all(docs, search.entity_grams(known), clients)
    got = sorted(map(tuple, found.select("client_id", "document_id", "alias", "via").collect()))
    want = sorted((k, *r) for k, n in enumerate(names) for r in history.recall(docs, known, history.aliases(n)).select("document_id", "alias", "via").collect())
    assert got == want and len(got) > 20
    assert "Contains(" not in found._jdf.queryExecution().analyzed().toString() and "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
