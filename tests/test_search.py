import sqlite3
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import search
from corpuslens.plans import understand

NOW = datetime(2026, 5, 17, 10, 30, tzinfo=timezone.utc)
TEXTS = ["invoice from acme acme", "contract with beta", "acme invoices paid", "請求書 の 件", "une élève, deux eleves", "nothing here at all"]


@pytest.mark.parametrize("query", ["acme", "invoice", "請求", "eleve", "acme beta", "x"])
def test_bm25_is_that_of_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize=\"unicode61 remove_diacritics 2\")")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", enumerate(TEXTS))
    match = " OR ".join(f'"{t}" OR "{t}"*' for t in query.split() if len(t) > 1)
    want = dict(con.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (match,))) if match else {}
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(docs, query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
    index, lengths = search.postings(docs)
    again = {r.doc_id: r.score for r in search.bm25_indexed(index, lengths, query).collect()}
    assert again.keys() == want.keys() and all(abs(again[k] - want[k]) < 1e-6 for k in want)


def candidate(document, text="", name="a.txt", path="/w/a.txt", kind="txt", age=400, raw=-1.0, entity=None, semantic=False, rrf=None, chunk="c"):
    return (document, f"{chunk}{document}", name, path, kind, NOW - timedelta(days=age), text, raw, entity, semantic, rrf)


def ranked(spark, rows, query, **more):
    df = spark.createDataFrame(
        rows, "document_id string, chunk_id string, name string, path string, kind string, mtime timestamp, text string, raw double, entity_term string, semantic boolean, rrf double"
    )
    return {r.document_id: r for r in search.rank(df, query, NOW, **more).collect()}


def test_rank_adds_boosts(spark):
    rows = [
        candidate("name", name="acme.txt", path="/w/acme.txt"),
        candidate("path", path="/acme/a.txt"),
        candidate("kind", kind="pdf"),
        candidate("entity", entity="acme"),
        candidate("fresh", age=0),
        candidate("near", raw=0.9, semantic=True),
        candidate("both", raw=-1.0, semantic=True, rrf=0.08, text="acme"),
    ]
    got = ranked(spark, rows, "acme invoice")
    assert {k: round(r.score, 4) for k, r in got.items()} == {"name": 6.0, "path": 2.0, "kind": 4.0, "entity": 3.0, "fresh": 3.0, "near": 1.0, "both": 1.08}
    assert got["name"].reason == "filename ~ 'acme'" and got["path"].reason == "fts match" and got["kind"].reason == "kind == pdf"
    assert got["both"].reason == "semantic; rrf=0.08" and got["both"].matched_terms == ["acme"]
    assert got["fresh"].reason == "recent"


def test_rank_keeps_the_best_chunk_and_the_period(spark):
    rows = [candidate("d", raw=-1.0, chunk="x"), candidate("d", raw=-3.0, chunk="y"), candidate("old", age=700)]
    got = ranked(spark, rows, "q", period=(NOW - timedelta(days=500), NOW), period_note="period: test")
    assert got.keys() == {"d"} and got["d"].chunk_id == "yd" and got["d"].reason == "period: test"


def test_fusion_needs_both_lists(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    assert {r.id: round(r.rrf, 6) for r in search.fuse([one, one], "id").collect()} == {"a": round(10 / 61, 6), "b": round(10 / 62, 6)}
    assert search.fuse([one, one.filter("false")], "id").count() == 0


def test_nearest_skips_other_dimensions(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0])], "chunk_id string, embedding array<float>")
    assert [(r.chunk_id, round(r.distance, 4)) for r in search.nearest(vectors, [1.0, 0.0], 5).collect()] == [("a", 0.0), ("b", 1.4142)]


def test_evidence_cuts_and_flags(spark):
    rows = spark.createDataFrame(
        [("d1", "w", "a.pdf", "/a.pdf", "pdf", None, "x" * 5000, 0.5, "ocr", 2.0, "r"), ("d2", "w", "b.txt", "/b.txt", "txt", "c2", "short", 1.0, "native", 1.0, "r")],
        "document_id string, workspace_id string, name string, path string, kind string, chunk_id string, text string, confidence double, extraction_method string, score double, reason string",
    )
    fields = spark.createDataFrame([("d1", f"k{i}", "v", 0.9) for i in range(12)], "document_id string, key string, value string, confidence double")
    got = search.evidence(rows, fields, "look at it").orderBy("position").collect()
    assert [r.source_id for r in got] == ["d1:doc", "c2"]
    assert len(got[0].extracted_text) == 4003 and got[0].truncated and len(got[0].fields) == 8
    assert got[0].low_confidence == "a.pdf (ocr) confidence=0.50" and got[0].suggested_action == "quote it by page"
    packet = search.packet(search.evidence(rows, fields, "the contract"), "the contract").first()
    assert packet.workspace_ids == ["w"] and packet.truncated and packet.low_confidence_items == ["a.pdf (ocr) confidence=0.50"]


def test_kind_preference():
    assert search.kind_preference("Excel sheet") == "xlsx" and search.kind_preference("議事録") == "docx" and search.kind_preference("hello") is None


PERIODS = {
    "先月の請求書": ((2026, 4, 1), (2026, 5, 1)),
    "this month": ((2026, 5, 17 - 16), (2026, 5, 31)),
    "two months ago": ((2026, 4, 1), (2026, 5, 1)),
    "last week": ((2026, 5, 5), (2026, 5, 11)),
    "this week": ((2026, 5, 11), (2026, 5, 17)),
    "昨年": ((2025, 1, 1), (2025, 12, 31)),
    "Q3 2024": ((2024, 7, 1), (2024, 9, 30)),
    "may we": ((2026, 5, 1), (2026, 5, 31)),
    "2025年4月": ((2025, 4, 1), (2025, 4, 30)),
    "INV-2025-03": ((2025, 3, 1), (2025, 3, 31)),
    "in 2024": ((2024, 1, 1), (2024, 12, 31)),
}


@pytest.mark.parametrize("text", PERIODS)
def test_periods(text):
    since, until, _ = understand.period(text, NOW)
    assert ((since.year, since.month, since.day), (until.year, until.month, until.day)) == PERIODS[text]


def test_period_keeps_the_time_of_day_unless_asked():
    assert understand.period("last month", NOW)[1] == datetime(2026, 5, 1, 10, 29, 59, tzinfo=timezone.utc)
    since, until, _ = understand.period("two months ago", NOW, calendar=True)
    assert since == datetime(2026, 3, 1, tzinfo=timezone.utc) and until == datetime(2026, 3, 31, 23, 59, 59, tzinfo=timezone.utc)
    since, until, _ = understand.period("last month", NOW, calendar=True)
    assert since == datetime(2026, 4, 1, tzinfo=timezone.utc) and until == datetime(2026, 4, 30, 23, 59, 59, tzinfo=timezone.utc)
    since, until, _ = understand.period("this week", NOW, calendar=True)
    assert since == datetime(2026, 5, 11, tzinfo=timezone.utc) and until == datetime(2026, 5, 17, 23, 59, 59, tzinfo=timezone.utc)


def test_parse_collects_kinds():
    out = understand.parse("invoice and slides of 2024", NOW)
    assert out.kinds == ["pdf", "pptx"] and out.period_note == "period: year 2024"
    assert understand.parse("", NOW).since is None


def test_bm25_without_terms(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert search.bm25(docs, "?").count() == 0 and search.bm25(docs, "word").count() == 0
    assert search.bm25(docs.filter("false"), "word").agg(F.count("*")).first()[0] == 0


def test_substrings_of_entities_come_from_the_index(spark, tmp_path):
    texts = ["Acme GmbH", "acme corp", "x", "ab", "ABC", "İstanbul Ltd", "日本株式会社", "a.b@c.de", "aaaa", "", "100%_\\x", "acme GMBH"]
    rows = [(f"d{k % 7}", t) for k, t in enumerate(texts)] + [("d9", None)]
    known = spark.createDataFrame(rows, "document_id string, text string")
    grams = search.entity_grams(known)
    grams.sort("gram").write.parquet(f"{tmp_path}/grams")
    grams = spark.read.parquet(f"{tmp_path}/grams")
    for query in ("acme", "gmbh zzz", "a", "ab b", "x\\ %_ 株 式会社 本株", "aaa aa c.d", "", "  ", "ACME corp"):
        got = search.entity_documents_indexed(grams, query, per_term=100, shortest=1)
        want = {(t, k, d) for k, t in enumerate(query.split()[:5]) for d, text in rows if text and t.lower() in text.lower()}
        assert {tuple(r) for r in got.collect()} == want
        three = search.entity_documents_indexed(grams, query, docs=spark.createDataFrame([(f"d{k}",) for k in range(5)], "document_id string"), per_term=2)
        scan = search.entity_documents(known.filter("document_id < 'd5'"), query, per_term=2)
        assert {tuple(r) for r in three.collect()} == {tuple(r) for r in scan.collect()}
    plan = search.entity_documents_indexed(grams, "acme", per_term=100)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram," in plan or "EqualTo(gram" in plan
