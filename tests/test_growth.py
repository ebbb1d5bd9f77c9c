"""Work that must not grow with the square of a text's length, or be done where its outcome is known."""

import difflib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.functions import embed
from corpuslens.functions import text as T
from corpuslens.operators import contracts, entities


def test_bodies_that_hold_each_other_are_not_matched(monkeypatch):
    ratio = lambda a, b: max(0.0, 1.0 - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) if a or b else 0.0
    pairs = [("", ""), ("", "ab"), ("ab ab", "ab ab"), ("ab", "ab!"), ("xabab", "ab"), ("abcab", "cab"), ("abc", "abd"), ("aab", "aba")]
    assert [contracts.edit_ratio(a, b) for a, b in pairs] == [ratio(a, b) for a, b in pairs]
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert contracts.edit_ratio("a" * 200_000, "a" * 200_000) == 0.0 and contracts.edit_ratio("ab" * 100_000, "ab" * 100_000 + "!") > 0
    assert contracts.hunks("a\nb", "a\nb") == []


def test_names_of_companies_in_a_long_run(spark):
    texts = [("c1", "d", "a" * 150_000), ("c2", "d", "東京abc株式会社Acme-b c有限会社 Acme 社団法人")]
    rows = spark.createDataFrame(texts, "chunk_id string, document_id string, text string")
    began = time.time()
    found = [(r.chunk_id, r.text) for r in entities.extract(rows, kinds=("org",)).collect()]
    assert time.time() - began < 20
    assert found[0] == ("c2", "東京abc株式会社") and len(found) > 1 and all(k == "c2" for k, _ in found)


def test_stripping_a_text_with_much_white_space_inside(spark):
    rows = spark.createDataFrame([("a" + " " * 300_000 + "b",), (" 　\x85a​ ",)], "t string")
    began = time.time()
    assert [len(r[0]) for r in rows.select(T.strip(F.col("t"))).collect()] == [300_002, 2]
    assert time.time() - began < 20


def test_texts_to_embed_come_in_bounded_batches(spark):
    spark.conf.unset(embed.BYTES)
    rows = spark.range(200).select(F.col("id").cast("string").alias("chunk_id"), F.lit("w").alias("workspace_id"), F.lit("d").alias("document_id"), F.lit("some words").alias("text"))
    made = embed.embed(rows.coalesce(1), lambda texts: [[float(len(texts))] for _ in texts])
    assert sorted({r.embedding[0] for r in made.collect()}) == [8.0, 64.0]
    assert int(spark.conf.get(embed.BYTES)) == 8 << 20


def test_patterns_are_not_tried_where_nothing_can_match(spark):
    """A word of very many parts without an @ is no address."""
    rows = spark.createDataFrame([("c1", "d", "a." * 150_000), ("c2", "d", "a.b@c.de")], "chunk_id string, document_id string, text string")
    began = time.time()
    found = entities.extract(rows, kinds=("money", "date", "email", "url", "org")).collect()
    assert time.time() - began < 20 and [(r.chunk_id, r.kind, r.text) for r in found] == [("c2", "email", "a.b@c.de")]


PLAIN = {
    "money": r"(?i)[¥$€]\s?\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?|\d{1,3}(?:[,，]\d{3})*\s*円|\d+(?:\.\d+)?\s*(?:万円|百万円|億円)|(?:USD|JPY|EUR|GBP|CNY)\s*\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?",
    "date": r"\d{4}[-/年]\s?\d{1,2}[-/月]\s?\d{1,2}日?|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}年\d{1,2}月|\d{1,2}月\d{1,2}日",
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "phone": r"\+?\d{1,3}[-\s.]?\(?\d{1,4}\)?[-\s.]?\d{2,4}[-\s.]?\d{3,4}|0\d{1,4}-\d{1,4}-\d{3,4}|\(\d{2,4}\)\s?\d{3,4}-?\d{3,4}",
    "url": r"""(?i)https?://[^\s<>"'()]+|www\.[A-Za-z0-9.\-]+\.[A-Za-z]{2,}[^\s<>"'()]*""",
    "org": r"(?:株式会社|有限会社|合同会社|合資会社|合名会社) ?[一-鿿ぁ-ヿ㐀-䶿A-Za-z0-9・\-]+|[一-鿿ぁ-ヿ㐀-䶿A-Za-z0-9・\-]+ ?(?:株式会社|有限会社|合同会社|社団法人)",
    "org of another form": r"\b[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+){0,3}\s*(?:Inc\.?|LLC|Ltd\.?|Limited|Corp\.?|Corporation|GmbH|S\.A\.|Co\.,?\s*Ltd\.?|K\.K\.)\b",
}
PARTS = st.sampled_from(
    "株式会社|有限会社|社団法人|合資会社|Acme|Blue|Inc.|Ltd| Co., Ltd|K.K.|S.A.|GmbH| | |  |\n|\t|-|.|,|，|/|年|月|日|円|万円|億円|$|¥|€|USD|eur |Gbp|1|23|456|2024|05|(|)|+|@|a|x.de|foo|www.|WWW.|http://|HTTPS://|<|ü|東京|カナ|・|%|_|　|\xa0|ſ|９|²".split("|")
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=30).map("".join))
def test_entities_are_those_of_the_plain_patterns(text):
    want = {}
    for name, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            if value := m[0].strip(" "):
                want.setdefault((name.split(" ")[0], value.lower()), value)
    assert [(kind, value) for value, kind, _ in entities.found_in(text, ("money", "date", "email", "phone", "url", "org"))] == [(kind, value) for (kind, _), value in want.items()]
