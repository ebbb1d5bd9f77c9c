"""Text functions as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēėęěğīįıłńňōőřśšşťūůűźžż"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeeegiiilnnoorssstuuuzzz"
assert len(_ACCENTED) == len(_PLAIN)
#: What Python's splitlines breaks at.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: White space as Unicode has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def fold(text: Column) -> Column:
    """Lower case without diacritics (of Latin letters)."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded. Null gives none."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    """Search terms: runs of word characters of two or more characters, folded like the index."""
    found = re.findall(r"\w{2,}", text)
    table = str.maketrans(_ACCENTED, _PLAIN)
    out = [t for w in found for t in re.split(r"_+", w.lower().translate(table)) if t]
    return list(dict.fromkeys(out))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACE))


def lines(text: Column) -> Column:
    """Lines as splitlines gives them: no empty one after a final break."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def normal_body(text: Column) -> Column:
    """Lines trimmed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(lines(text), lambda x: strip(x)), lambda x: x != ""), "\n")


def slug(value: Column, longest: int = 40) -> Column:
    """A name safe for files: the local part of an e-mail address, runs of other characters than a-z0-9 as one hyphen."""
    local = F.substring_index(F.lower(strip(value)), "@", 1)
    out = F.substring(F.regexp_replace(F.regexp_replace(local, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, longest)
    return F.when(F.length(out) > 0, out).otherwise("x")


def language(text: Column, hint: Column | None = None) -> Column:
    """ja if there is a kana or kanji, else en; a hint other than auto wins."""
    found = F.when(F.coalesce(text, F.lit("")).rlike("[぀-ヿ㐀-鿿ｦ-ﾟ]"), "ja").otherwise("en")
    return found if hint is None else F.when(hint.isNotNull() & (hint != "auto") & (hint != ""), hint).otherwise(found)


def shortened(text: Column, longest: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit(mark))).otherwise(text)


def first_line(text: Column, longest: int = 140) -> Column:
    """The first line that isn't blank."""
    found = F.get(F.filter(F.transform(lines(text), lambda x: strip(x)), lambda x: x != ""), F.lit(0))
    return F.coalesce(shortened(found, longest, "…"), F.lit(""))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
