"""Personal data in text: card numbers, phone numbers, personal numbers, with places and short evidence.

Places and the words around a hit decide, which regular expressions of the JVM don't give; so texts go to Python in Arrow
batches, once, and only those with a digit run long enough to matter (a filter in the scan's stage; digits of any script, as in Python)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words near a run of twelve digits that make it a personal number; words near a card-like run that make it
#: something else.
PERSONAL_WORDS = ("マイナンバー", "個人番号", "個人No", "個人 No", "My Number", "MyNumber")
NOT_A_CARD = ("INV", "伝票", "追跡", "JAN", "ISBN", "978", "979", "法人番号", "事業者番号", "商品コード", "tracking", "コード", "口座", "普通", "当座")
#: Digit runs by kind.
PERSONAL = r"(?<!\d)\d{12}(?!\d)"
CARD = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
PHONES = (
    r"(?<!\d)0[578]0[- ]\d{4}[- ]\d{4}(?!\d)",
    r"(?<!\d)0\d{1,4}[- ]\d{1,4}[- ]\d{3,4}(?!\d)",
    r"(?<!\d)\+81[ -]?\d{1,4}[ -]?\d{1,4}[ -]?\d{3,4}(?!\d)",
)
PHONE_DIGITS, NEAR, BEFORE, AFTER, EVIDENCE = 10, 30, 20, 8, 12


class Hit(NamedTuple):
    kind: str
    value: str
    start: int
    end: int
    evidence: str


def luhn(digits: str) -> bool:
    """The check sum of card numbers; zeros alone don't pass."""
    values = [int(d) for d in digits[::-1]]
    total = sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])
    return total > 0 and total % 10 == 0


def evidence(text: str, start: int, end: int) -> str:
    a, b = max(0, start - EVIDENCE), min(len(text), end + EVIDENCE)
    return ("…" if a else "") + text[a:b].replace("\n", " ").strip() + ("…" if b < len(text) else "")


def scan_text(text: str | None) -> list[Hit]:
    """All hits in a text, by place, then kind."""
    if not text:
        return []
    spans: set[tuple[str, int, int]] = set()
    for m in re.finditer(PERSONAL, text):
        around = text[max(0, m.start() - NEAR) : m.end() + NEAR]
        if any(w in around for w in PERSONAL_WORDS):
            spans.add(("mynumber", *m.span()))
    for m in re.finditer(CARD, text):
        digits = re.sub(r"\D", "", m[0])
        around = (text[max(0, m.start() - BEFORE) : m.start()] + " " + text[m.end() : m.end() + AFTER]).lower()
        if luhn(digits) and not any(w.lower() in around for w in NOT_A_CARD):
            spans.add(("credit_card", *m.span()))
    for pattern in PHONES:
        spans.update(("phone", *m.span()) for m in re.finditer(pattern, text) if sum(c.isdigit() for c in m[0]) >= PHONE_DIGITS)
    return [Hit(kind, text[a:b], a, b, evidence(text, a, b)) for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2]))]


def scan(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """One row per hit: key, kind, value, start, end, evidence."""
    kind = dict(docs.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *hit) for k, t in zip(frame[key], frame["_text"]) for hit in scan_text(t)]
            yield pd.DataFrame(rows, columns=[key, "kind", "value", "start", "end", "evidence"])

    some = docs.select(key, F.col(text).alias("_text")).filter(F.col("_text").rlike(r"(?U)(?:\d[ -]?){9}\d"))
    return some.mapInPandas(run, f"{key} {kind}, kind string, value string, start int, end int, evidence string")


def flagged(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """key and the kinds of personal data in a document that has some."""
    return scan(docs, key, text).groupBy(key).agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.count("*").alias("hits"))


def luhn_column(digits):  # noqa: ANN001, ANN201
    """The check sum as an expression, for strings of digits."""
    of = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    total = F.aggregate(of, F.lit(0), lambda s, x: s + x)
    return (total > 0) & (total % 10 == 0)
