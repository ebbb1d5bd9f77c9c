"""Alignment of tokenizers, fill-in-the-middle and main texts of pages: against brute force, libraries and awkward rows."""

import hashlib
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import DATA  # noqa: E402

from corpuslens.llm import align, fim, pages  # noqa: E402
from corpuslens.llm.bpe import printable  # noqa: E402
from corpuslens.llm.queries import QUERIES  # noqa: E402

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_FILE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_FILE)

# ---- alignment


def token_bytes(text):
    """Ids and bytes of A's and B's tokens by their libraries; none where they don't spell the text."""
    if not text:
        return [], []
    byte = printable()
    a = [(i, bytes(byte[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    same = b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode()
    return (a, b) if same else ([], [])


def brute(rows):
    """The contract word by word."""
    docs, links = [], Counter()
    for doc_id, text in rows:
        a, b = token_bytes(text)
        ends = [[sum(len(x) for _, x in t[: k + 1]) for k in range(len(t))] for t in (a, b)] if len(a) < 3000 else [np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b)]
        at = {e: i for e, (i, _) in zip(ends[1], b)}
        own = [(i, at[e]) for e, (i, _) in zip(ends[0], a) if e in at]
        cuts, groups, i, j = [e for e in ends[0] if e in at], [], 0, 0
        for c in cuts:
            x = i
            while i < len(a) and ends[0][i] <= c:
                i += 1
            y = j
            while j < len(b) and ends[1][j] <= c:
                j += 1
            groups.append(",".join(str(k) for k, _ in a[x:i]) + "|" + ",".join(str(k) for k, _ in b[y:j]))
        links.update(own)
        docs.append((doc_id, len(a), len(b), len(groups), own, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    return Counter((d, a, b, g, len(own), sum(links[p] == top[p[1]] for p in own), sum(links[p] for p in own), h) for d, a, b, g, own, h in docs)


def measured(df):
    return Counter(tuple(r) for r in align.scores(df, A_FILE, B_FILE).select(*(c.split(" ")[0] for c in align.SCORED.split(", "))).collect())


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "Same  text here"), (4, "Same  text here"), (None, "no id"), (None, None), (5, "<|endoftext|> x<s></s>"), (6, "a▁b"), (7, "ünï 的か \U0001f600 z̈"),
    (8, "nul\x00 and\r\ncr"), (9, " leads"), (10, "trails "), (11, "ﬁ ① ½"), (12, "x" * 500), (13, " ".join(f"word{i % 97} and {i}" for i in range(2000))),
]


def test_alignment_of_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({"a_ids": F.lit("clash"), "block": F.lit(1), "key": F.lit(2)})
    assert measured(df) == brute(AWKWARD)
    assert measured(df.filter("false")) == Counter()


def test_alignment_of_documents(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_LINKS", 5000)
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert Counter(tuple(r[c.split(" ")[0]] for c in align.SCORED.split(", ")) for r in QUERIES["op11_cross_tokenizer_alignment"](spark, DATA).collect()) == brute(rows)


def test_rows_of_blocks_are_bounded(spark):
    """However many links a block or a text has: Parquet's writer holds a hundred rows before it looks at its memory."""
    rows = [(k, " ".join(f"word{i % 997} and {i}" for i in range(n))) for k, n in enumerate((6000, 1, 0, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    table = align.blocks(df, A_FILE, B_FILE).toArrow().combine_chunks()
    assert max(table.slice(k, 1).nbytes for k in range(table.num_rows)) <= 1 << 15
    assert measured(df) == brute(rows)


def test_groups_overlaps_and_links(spark):
    text = "An unbelievable counterrevolutionary, 12345 naïve 的か"
    row = align.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A_FILE, B_FILE).first()
    first, last, group_a, group_b, link_a, link_b = (np.frombuffer(row[c], "<u4").astype(int) for c in ("first_b", "last_b", "group_a", "group_b", "link_a", "link_b"))
    a, b = token_bytes(text)
    ends_a, ends_b = (np.cumsum([len(x) for _, x in t]) for t in (a, b))
    starts_a, starts_b = ends_a - [len(x) for _, x in a], ends_b - [len(x) for _, x in b]
    for k in range(len(a)):
        assert [j for j in range(len(b)) if starts_b[j] < ends_a[k] and ends_b[j] > starts_a[k]] == list(range(first[k], last[k] + 1))
    assert group_a.sum() == len(a) and group_b.sum() == len(b) and (group_a > 0).all() and (group_b > 0).all()
    assert [(i, j) for i in range(len(a)) for j in range(len(b)) if ends_a[i] == ends_b[j]] == list(zip(link_a, link_b))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab c的か\n\U0001f600é,▁"), max_size=60))
def test_parts_of_a_text_encode_as_the_whole(text):
    own = align.pieces(B_FILE)
    before, align.PART_CHARS = align.PART_CHARS, 4
    try:
        ids, bounds = own.encode([text, "", text])
    finally:
        align.PART_CHARS = before
    assert ids.tolist() == 2 * B.encode(text) and np.diff(bounds).tolist() == [len(B.encode(text)), 0, len(B.encode(text))]


# ---- fill in the middle


def brute_form(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest, n = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(units)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.none(), st.integers(0, 10**6)), st.lists(st.sampled_from(["\n", "\r\n", "a", "é", "的 か", "\U0001f600", "<", "<P", "S>", "<M>", "\x85", "line of text"]), max_size=12).map("".join))
def test_forms_are_those_of_plain_python(doc_id, text):
    got = fim.arrange(text, doc_id, 7, 100, 50, fim.Marks())
    assert got == brute_form(doc_id, text)
    assert fim.rebuilt(got[4], got[1]) == text


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 2**300))
def test_ranked_bits(bits):
    assert [fim.select(bits, k) for k in range(bits.bit_count())] == [k for k in range(bits.bit_length()) if bits >> k & 1]


def test_forms_of_awkward_rows(spark):
    rows = AWKWARD + [(20, "one\ntwo\n<S>"), (21, "\n" * 50), (22, "".join(f"line {k} é\n" for k in range(300_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit("clash"), "output": F.lit("clash")})
    got = Counter(tuple(r) for r in fim.transform(df).collect())
    assert got == Counter((i, *brute_form(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.text) for r in fim.restore(fim.transform(df)).collect()) == Counter((i, t or "") for i, t in rows)
    some = Counter(r.form for r in fim.transform(spark.range(2000).selectExpr("id AS doc_id", "'a\nb\nc' AS text"), rate=40, spm_rate=25).collect())
    assert 1100 < some["plain"] < 1300 and 140 < some["spm"] < 260
    assert fim.transform(df.filter("false")).count() == 0


def test_marks_that_could_be_mistaken_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("aXa", "b", "c"), ("<P>", "x<", "y")):
        with pytest.raises(ValueError):
            fim.Marks(*marks)


# ---- pages

S = "This is a sentence of an article with several words in it, and some more."
CASES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>T &amp; U</h1><p>{S}<p>No.</article><footer>&copy; 1</footer>", f"T & U {S} No."),
    "line breaks and bold": (f"<article><p>a<b>b</b>c<br>d &nbsp; e\n f</p>{S}</article>", f"abc d e f {S}"),
    "comments of readers": (f"<div id=content><h1>Title</h1><p>{S}<p>Short.</div><div id='comments'>{f'<p>{S}</p>' * 9}</div>", f"Title {S} Short."),
    "comments as articles": (f"<article class=post><p>{S}</article><section id=comments><article class=comment><p>{S * 3}</article></section>", S),
    "share, form and advert inside": (f"<article><p>{S}</p><div class='share-bar'>Share</div><form><label>Mail</label><input></form><div class=ad-slot><p>{S} Buy</p></div><p>End.</p></article>", f"{S} End."),
    "title in a header": (f"<header>Site</header><main><article><header><h1>Own</h1></header><p>{S}</p><footer>by me</footer></article></main>", f"Own {S}"),
    "page in a form": (f"<form><div class='with-sidebar'><article><p>{S}</p></article></div><input></form>", S),
    "wrapper with a misleading name": (f"<div class='page banner'><p>{S}</p><p>{S}</p></div><div class=cookie-notice><p>Cookies. {S}</p></div>", f"{S} {S}"),
    "table layout": (f"<table><tr><td class=nav><a>a</a><br><a>b</a><td><h2>Head</h2>{S}<br>{S}</table>", f"Head {S} {S}"),
    "no marks at all": (f"<div><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul></div><div><h1>Head</h1><p>{S}<p>{S}<p>Ok.<p>{S}</div><div><a>x</a> <a>y</a></div>", f"Head {S} {S} Ok. {S}"),
    "hidden": (f"<main><p>{S}</p><span style='display: none'>hid</span> after<script>if (a < b) x('</p>')</script><p hidden>no</p><p>b</p></main>", f"{S} after b"),
    "unclosed comment": (f"<article><p>{S}</p><!-- never closed <p>x</p>", S),
    "declaration amid text": (f"<article><![CDATA[x]]><p>{S}<![if y]></article>", S),
    "plain text": ("just words", "just words"), "nothing": ("", ""), "null": (None, ""), "only a menu": ("<nav><a>x</a></nav>", ""), "only tags": ("<p><b></b>", ""),
    "one short article": ("<article>Hi</article>", "Hi"), "tag never ended": (f"<article><p>{S}</p>rest <a href='", f"{S} rest"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_main_text(name):
    html, want = CASES[name]
    assert pages.main_text(html) == want


def test_extraction_of_awkward_pages(spark):
    rows = [(k, None if k % 2 else f"u{k}", html) for k, (html, _) in enumerate(CASES.values())] + [(None, "u", CASES["article"][0])] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit("clash")})
    want = [(k, None if k % 2 else f"u{k}", t, len(t)) for k, (_, t) in enumerate(CASES.values())] + [(None, "u", CASES["article"][1], len(CASES["article"][1]))] * 2
    assert Counter(map(tuple, pages.extract(df).collect())) == Counter(want)
    assert pages.extract(df.filter("false")).count() == 0


def test_pages_that_are_long_or_broken_take_linear_time():
    assert len(pages.main_text("<article>" + f"<p>{S}</p>" * 50_000)) == 50_000 * (len(S) + 1) - 1
    for x in ("<a", "<!--", "</", "<b>", "<div>", "&", "<i>x</b>", "<![", "<?", '"<', "<a '"):
        pages.main_text(x * 20_000)
        pages.main_text(x * 20_000 + ">")


def test_smoothing_and_threshold():
    flat = pages.smooth(np.full(9, 3.0))
    assert np.allclose(flat, 3.0) and np.isclose(pages.smooth(np.array([5.0]))[0], 5.0)
    values = np.array([1.0, 2, 1, 40, 60, 50])
    assert 2 < pages.threshold(values) < 40 and pages.threshold(np.full(3, 7.0)) == pytest.approx(7.0)
