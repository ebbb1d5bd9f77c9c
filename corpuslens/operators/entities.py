"""Entities: money, dates, e-mail addresses, phone numbers, links and organisations in chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as st

from corpuslens.functions.embed import bounded

#: Characters of a company's name, and that none stands before.
_NAME = r"一-鿿ぁ-ヿ㐀-䶿A-Za-z0-9・\-"
_FRESH = rf"(?<![{_NAME}])"
#: What an entity of each kind looks like (classes as in Python: digits of any script), how sure that makes us, in the order of precedence.
#: Looks ahead, quantifiers that give nothing back, and a run of characters that is tried from its beginning only
#: spare attempts that must fail. A run of ASCII characters can name a company only if the form stands behind it.
PATTERNS = (
    (
        "money", 0.85,
        r"(?iU)(?-i:[¥$€\dUJEGCujegc])(?:(?<=[¥$€])\s?\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?"
        r"|(?<=\d)(?=[\d,，.]*+\s*+[円万百億])(?:\d{0,2}+(?:[,，]\d{3})*+\s*+円|\d*+(?:\.\d++)?+\s*+(?:万円|百万円|億円))"
        r"|(?:(?<=U)SD|(?<=J)PY|(?<=E)UR|(?<=G)BP|(?<=C)NY)\s*\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?)",
    ),
    ("date", 0.85, r"(?U)\d(?=\d{0,3}+[-/年月])(?:\d{3}[-/年]\s?\d{1,2}[-/月]\s?\d{1,2}日?|\d?[/-]\d{1,2}[/-]\d{2,4}|\d{3}年\d{1,2}月|\d?月\d{1,2}日)"),
    ("email", 0.95, r"(?U)\b[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    (
        "phone", 0.80,
        r"(?U)\+?\d{1,3}[-\s.]?\(?\d{1,4}\)?[-\s.]?\d{2,4}[-\s.]?\d{3,4}|0\d{1,4}-\d{1,4}-\d{3,4}|\(\d{2,4}\)\s?\d{3,4}-?\d{3,4}",
    ),
    ("url", 0.95, r"""(?iU)https?://[^\s<>"'()]+|www\.[A-Za-z0-9.\-]+\.[A-Za-z]{2,}[^\s<>"'()]*"""),
    (
        "org", 0.80,
        rf"(?U)(?=[株有合])(?:株式会社|有限会社|合同会社|合資会社|合名会社) ?[{_NAME}]+"
        rf"|{_FRESH}(?![A-Za-z0-9\-]++(?! ?[一-鿿ぁ-ヿ㐀-䶿・]))[{_NAME}]+ ?(?:株式会社|有限会社|合同会社|社団法人)",
    ),
    (
        "org", 0.75,
        r"(?U)[A-Z](?<=\b[A-Z])[A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+){0,3}\s*(?:Inc\.?|LLC|Ltd\.?|Limited|Corp\.?|Corporation|GmbH|S\.A\.|Co\.,?\s*Ltd\.?|K\.K\.)\b",
    ),
)
MOST_PER_KIND = 50


#: Texts that become Python objects at once.
TOGETHER = 1024


def _compiled(pattern: str) -> re.Pattern:
    flags, own = re.match(r"\((\?i?)U\)(.*)", pattern, re.DOTALL).groups()
    return re.compile(own, re.IGNORECASE if "i" in flags else 0)


_RUN, _FORM, _DIALLED = re.compile(f"[{_NAME} ]+"), re.compile("会社|法人"), re.compile(r"[+\d(][+\d\-\s.()]*")
_CHARACTERS = frozenset(c for c in map(chr, range(0x10000)) if _RUN.match(c))
_BEHIND = _compiled(next(p for _, _, p in PATTERNS if _FRESH in p).replace(_FRESH, ""))

# All matches of a pattern in a text. It is tried only if the text holds a sign of one, and if it never meets white space, in the words with a sign.


def _money(p: re.Pattern, text: str) -> list[str]:
    if "¥" in text or "$" in text or "€" in text or "円" in text:
        return p.findall(text)
    up = text.upper()
    return p.findall(text) if "USD" in up or "JPY" in up or "EUR" in up or "GBP" in up or "CNY" in up else []


def _mails(p: re.Pattern, text: str) -> list[str]:
    return [v for w in text.split() if "@" in w for v in p.findall(w)] if "@" in text else []


def _phones(p: re.Pattern, text: str) -> list[str]:
    """In the runs of a number's characters that are as long as the shortest."""
    return [v for run in _DIALLED.findall(text) if len(run) >= 7 for v in p.findall(run)]


def _links(p: re.Pattern, text: str) -> list[str]:
    if "www." in text.lower():
        return [v for w in text.split() if "://" in w or "www." in w.lower() for v in p.findall(w)]
    return [v for w in text.split() if "://" in w for v in p.findall(w)] if "://" in text else []


def _names(p: re.Pattern, text: str) -> list[str]:
    """In the runs of a name's characters and spaces that hold a form; right behind a name another one may begin."""
    found, end = [], 0
    while form := _FORM.search(text, end):
        start = form.start()
        while start > end and text[start - 1] in _CHARACTERS:
            start -= 1
        run = _RUN.match(text, start)
        at, end, run = 0, run.end(), run[0]
        while m := _BEHIND.match(run, at) or p.search(run, at):
            found.append(m[0])
            at = m.end()
    return found


def _companies(p: re.Pattern, text: str) -> list[str]:
    some = "Ltd" in text or "Inc" in text or "LLC" in text or "Limited" in text or "Corp" in text or "GmbH" in text or "S.A." in text or "K.K." in text
    return p.findall(text) if some else []


@lru_cache
def _finders(kinds: tuple[str, ...]) -> list[tuple[str, list[tuple[float, Callable[[str], list[str]]]]]]:
    """For each kind the confidence of its patterns and what gives their matches in a text."""
    ways = {"money": _money, "email": _mails, "phone": _phones, "url": _links, "org": _companies}
    way = lambda kind, p: partial(_names if _FRESH in p else ways.get(kind, re.Pattern.findall), _compiled(p))
    return [(kind, [(sure, way(k, p)) for k, sure, p in PATTERNS if k == kind]) for kind in kinds]


def found_in(text: str, kinds: tuple[str, ...], most: int = MOST_PER_KIND) -> list[tuple[str, str, float]]:
    """(text, kind, confidence) of the distinct entities (ignoring case) of a text, of each kind the first ``most``."""
    out = []
    for kind, finders in _finders(kinds):
        seen: set[str] = set()
        for sure, find in finders:
            for value in dict.fromkeys(find(text)):
                value = value.strip(" ")
                low = value.lower()
                if low and low not in seen and len(seen) < most:
                    seen.add(low)
                    out.append((value, kind, sure))
    return out


def extract(chunks: DataFrame, most: int = MOST_PER_KIND, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """document_id, chunk_id, text, kind, confidence: for each chunk the distinct entities (ignoring case), of each kind the
    first ``most``. Only the patterns of the wanted kinds are looked for. Chunks never meet, so nothing is shuffled; texts go to Python's
    patterns in bounded batches."""
    wanted, own = tuple(k for k in dict.fromkeys(k for k, _, _ in PATTERNS) if kinds is None or k in kinds), ("document_id", "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), TOGETHER):
                part = whole.slice(k, TOGETHER)
                found = [found_in(t.decode("utf-8", "replace"), wanted, most) for t in part.column("text").to_pylist()]
                at = pa.array([i for i, own in enumerate(found) for _ in own], pa.int32())
                values, called, sure = zip(*(e for own in found for e in own)) if len(at) else ((),) * 3
                columns = [*(part.column(c).take(at) for c in own), pa.array(values, pa.string()), pa.array(called, pa.string()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*own, "text", "kind", "confidence"])

    texts = chunks.select(*own, F.coalesce("text", F.lit("")).cast("binary").alias("text"))  # bytes, as a text may be no UTF-8
    fields = [*(texts.schema[c] for c in own), st.StructField("text", st.StringType()), st.StructField("kind", st.StringType()), st.StructField("confidence", st.DoubleType())]
    return bounded(texts).mapInArrow(run, st.StructType(fields))


def per_document(entities: DataFrame, most: int = MOST_PER_KIND) -> DataFrame:
    """The entities of each document, each once, the surest spelling, of each kind the ``most`` that occur most often."""
    counted = entities.groupBy("document_id", "kind", F.lower("text").alias("value")).agg(F.count("*").alias("times"), F.max("confidence").alias("confidence"))
    place = F.row_number().over(Window.partitionBy("document_id", "kind").orderBy(F.desc("times"), "value"))
    return counted.withColumn("place", place).filter(F.col("place") <= most).drop("place")
