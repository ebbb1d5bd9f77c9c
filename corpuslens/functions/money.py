"""Amounts of money in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies by symbol and by code, and the scales of Japanese units.
SYMBOLS = {"¥": "JPY", "￥": "JPY", "$": "USD", "€": "EUR", "£": "GBP"}
CODES = ("JPY", "USD", "EUR", "GBP", "CNY", "KRW")
UNITS = (("億円", 100_000_000), ("百万円", 1_000_000), ("万円", 10_000), ("円", 1))
#: A number with separators for thousands; ``plain`` also takes one without them, which the grouped form cuts short.
GROUPED = r"\d{1,3}(?:[,，\s]\d{3})*(?:\.\d+)?"
PLAIN = r"\d{1,3}(?:[,，\s]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"


def number(text: Column, legacy: bool = False) -> Column:
    """The first number in a text, or null."""
    found = F.regexp_extract(text, f"({GROUPED if legacy else PLAIN})", 1)
    return F.regexp_replace(found, r"[,，\s]", "").try_cast("double")


def parse_amount(value: Column, legacy: bool = False) -> Column:
    """struct(currency, amount) or null: by symbol in front, by code in front, by Japanese unit. A bare number has no
    currency and gives null. ``legacy`` reads ``¥120000`` as 120, as grouping by three demands."""
    s = F.trim(F.coalesce(value, F.lit("")))
    cases: list[tuple[Column, Column, str, int]] = []
    for symbol, code in SYMBOLS.items():
        cases.append((s.startswith(symbol), number(F.substring(s, 2, 2**31 - 1), legacy), code, 1))
    for code in CODES:
        cases.append((F.upper(s).startswith(code), number(F.substring(s, 4, 2**31 - 1), legacy), code, 1))
    for unit, scale in UNITS:
        cases.append((s.contains(unit), number(F.substring_index(s, unit, 1), legacy), "JPY", scale))
    options = [F.when(test & amount.isNotNull(), F.struct(F.lit(code).alias("currency"), (amount * scale).alias("amount"))) for test, amount, code, scale in cases]
    return reduce(lambda a, b: F.coalesce(a, b), options)
