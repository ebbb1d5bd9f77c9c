"""Contracts: cutting texts into clauses, and comparing the clauses of two versions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T

#: How headings of clauses begin, and limits.
CLAUSES = (
    r"(?U)^\s*第\s*(\d+)\s*条\b\s*(.*)$",
    r"(?iU)^\s*(?:Section|Article|Clause)\s+(\d+)\b\s*[.):\-—–]?\s*(.*)$",
    r"(?U)^\s*(\d+)\s*[.)]\s+(\S.+)$",
)
PROSE, LONGEST_HEADING, LONGEST_BODY, CONFIDENCE = r"[。．.]\s*\S", 60, 4096, 0.9
BRACKETS_LEFT, BRACKETS_RIGHT = r"^[\s(（【「『〈《\[]+", r"[\s)）】」』〉》\]]+$"
#: Words that turn an obligation round, and limits of similarity.
NEGATIONS = ("なし", "無し", "無", "ない")
NUMBERS = r"\d+(?:[.,]\d+)*"
WORDING, SAME_TITLE, CONTEXT = 0.10, 0.40, 3


def stitch(chunks: DataFrame) -> DataFrame:
    """document_id and its whole text: its chunks in order, with a blank line between."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda c: c["text"])
    return chunks.groupBy("document_id").agg(F.array_join(parts, "\n\n").alias("text"))


def _heading(line: Column) -> Column:
    """struct(ordinal, title, heading) of a line that opens a clause, or null."""
    marked = line.rlike(r"^#+\s+")
    inner = F.when(marked, F.rtrim(F.regexp_replace(line, r"^#+\s+", ""))).otherwise(T.strip(line))
    plain = marked | ((F.length(inner) <= LONGEST_HEADING) & ~inner.rlike(PROSE))
    tries = []
    for pattern in CLAUSES:
        title = T.strip(F.regexp_replace(F.regexp_replace(F.regexp_extract(inner, pattern, 2), BRACKETS_LEFT, ""), BRACKETS_RIGHT, ""))
        number = F.regexp_extract(inner, pattern, 1).try_cast("int")
        tries.append(F.when(plain & inner.rlike(pattern) & number.isNotNull(), F.struct(number.alias("ordinal"), title.alias("title"), inner.alias("heading"))))
    return F.coalesce(*tries)


def sections(texts: DataFrame, longest: int | None = None) -> DataFrame:
    """document_id, position, ordinal, title, heading, body, char_offset. Each line is looked at once, as an element of its text's array;
    texts without a clause end there. The lines of the others become rows: a running sum of lengths gives their places, a running
    count of headings the clause they belong to, and the lines of a clause make its body. Both windows and the
    grouping go by text, so there is one shuffle, and the work grows with the number of lines."""
    lined = texts.select("document_id", F.explode(F.array(F.split(F.coalesce("text", F.lit("")), r"(?<=\n)|(?<=\r)(?!\n)"))).alias("lines"))
    headed = lined.select("document_id", "lines", F.explode(F.array(F.transform("lines", lambda x: _heading(F.regexp_replace(x, r"[\r\n]+$", ""))))).alias("heads"))
    headed = headed.filter(F.exists("heads", lambda h: h.isNotNull())).withColumn("row", F.monotonically_increasing_id())
    rows = headed.select("document_id", "row", F.posexplode(F.arrays_zip("lines", "heads")).alias("k", "line")).select("document_id", "row", "k", F.col("line.lines").alias("line"), F.col("line.heads").alias("head"))
    before = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"at": F.sum(F.length("line")).over(before) - F.length("line"), "clause": F.count("head").over(before)}).filter("clause > 0")
    under = F.transform(F.sort_array(F.collect_list(F.when(F.col("head").isNull(), F.struct("k", "line")))), lambda x: x["line"])
    cut = rows.groupBy("row", "clause").agg(F.first("document_id").alias("document_id"), F.max("head").alias("head"), F.min("at").alias("char_offset"), T.strip(F.array_join(under, "")).alias("body"))
    return cut.select(
        "document_id", (F.col("clause") - 1).cast("int").alias("position"), "head.ordinal", "head.title", "head.heading",
        (F.col("body") if longest is None else F.substring("body", 1, longest)).alias("body"), F.col("char_offset").cast("int").alias("char_offset"),
    )


def preamble(texts: DataFrame, cut: DataFrame) -> DataFrame:
    """document_id and the text before its first clause; the whole text where there is none."""
    first = cut.groupBy("document_id").agg(F.min("char_offset").alias("end"))
    kept = F.when(F.col("end").isNull(), F.col("text")).otherwise(F.regexp_replace(F.substring("text", F.lit(1), F.col("end")), r"\s+$", ""))
    return texts.join(first, "document_id", "left").select("document_id", kept.alias("preamble"))


def as_fields(cut: DataFrame) -> DataFrame:
    """Clauses as rows of fields: section.N.title, section.N.heading, section.N.body."""
    pairs = F.array(*(F.struct(F.concat(F.lit("section."), F.col("ordinal").cast("string"), F.lit(f".{k}")).alias("key"), F.col(k).alias("value")) for k in ("title", "heading", "body")))
    return cut.select("document_id", F.explode(pairs).alias("f")).select("document_id", "f.key", "f.value", F.lit("text").alias("value_type"), F.lit(CONFIDENCE).alias("confidence"), F.lit("contract.sections").alias("extractor"))


def substantive(a: Column, b: Column) -> Column:
    """Whether two bodies differ in their numbers or in how often they negate."""
    runs = lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?U){NUMBERS}"), F.lit(0))))
    out = runs(a) != runs(b)
    for word in NEGATIONS:
        out = out | (F.regexp_count(a, F.lit(word)) != F.regexp_count(b, F.lit(word)))
    return out


def similarity(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity of two titles, ignoring case."""
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 1.0


def edit_ratio(a: str, b: str) -> float:
    if a in b or b in a:  # the longest match is all of the shorter one: no need to look for it
        return 1.0 - 2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 0.0
    return max(0.0, 1.0 - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) if a or b else 0.0


def hunks(a: str, b: str) -> list[str]:
    """The blocks of a unified diff of two normal bodies."""
    if a == b:
        return []
    listed = list(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=CONTEXT))[2:]
    starts = [k for k, line in enumerate(listed) if line.startswith("@@")]
    return ["\n".join(listed[i:j]) for i, j in zip(starts, [*starts[1:], len(listed)])]


def pair_up(left: list[dict], right: list[dict]) -> list[tuple[dict | None, dict | None]]:
    """Clauses of the same number and a similar title; then, for each one left, the most similar title; then the rest."""
    rest_a, rest_b = list(range(len(left))), list(range(len(right)))
    out: list[tuple[dict | None, dict | None]] = []
    for i in list(rest_a):
        same = [j for j in rest_b if right[j]["ordinal"] == left[i]["ordinal"]]
        if same and similarity(left[i]["title"], right[same[-1]]["title"]) >= SAME_TITLE:
            out.append((left[i], right[same[-1]]))
            rest_a.remove(i)
            rest_b.remove(same[-1])
    for i in list(rest_a):
        near = [(similarity(left[i]["title"], right[j]["title"]), -k, j) for k, j in enumerate(rest_b)]
        if near and max(near)[0] >= SAME_TITLE:
            out.append((left[i], right[max(near)[2]]))
            rest_a.remove(i)
            rest_b.remove(max(near)[2])
    return out + [(left[i], None) for i in rest_a] + [(None, right[j]) for j in rest_b]


COMPARED = "pair_id string, place int, ordinal_a int, ordinal_b int, title_a string, title_b string, status string, edit_ratio double, hunks array<string>"


def compare(sections_a: DataFrame, sections_b: DataFrame) -> DataFrame:
    """Pairs of clauses of two versions with their status: identical, wording, substantive, added or removed. Both tables have
    pair_id beside the columns of ``sections``. A pair of contracts is a group; its clauses are few."""
    shape = lambda df, side: df.select(F.col("pair_id").cast("string").alias("pair_id"), F.lit(side).alias("side"), "position", "ordinal", "title", T.normal_body(F.col("body")).alias("body"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        left, right = (frame[frame["side"] == s][["ordinal", "title", "body"]].to_dict("records") for s in ("a", "b"))
        rows = []
        for place, (a, b) in enumerate(pair_up(left, right)):
            ratio, blocks, status = None, [], "added" if a is None else "removed"
            if a is not None and b is not None:
                ratio, blocks, status = edit_ratio(a["body"], b["body"]), hunks(a["body"], b["body"]), "paired"
            rows.append((frame["pair_id"].iloc[0], place, *(x and int(x["ordinal"]) for x in (a, b)), *(x and x["title"] for x in (a, b)), status, ratio, blocks, *(x["body"] if x else "" for x in (a, b))))
        return pd.DataFrame(rows, columns=["pair_id", "place", "ordinal_a", "ordinal_b", "title_a", "title_b", "status", "edit_ratio", "hunks", "body_a", "body_b"]).astype({"ordinal_a": "Int32", "ordinal_b": "Int32"})

    both = shape(sections_a, "a").unionByName(shape(sections_b, "b"))
    paired = both.groupBy("pair_id").applyInPandas(run, f"{COMPARED}, body_a string, body_b string")
    status = (
        F.when(F.col("status") != "paired", F.col("status"))
        .when(F.col("body_a") == F.col("body_b"), "identical")
        .when(substantive(F.col("body_a"), F.col("body_b")) | (F.col("edit_ratio") >= WORDING), "substantive")
        .otherwise("wording")
    )
    return paired.withColumn("status", status).withColumn("edit_ratio", F.round("edit_ratio", 4)).drop("body_a", "body_b")


def difference_summary(compared: DataFrame) -> DataFrame:
    """How many clauses of each pair have each status; all five are there."""
    return compared.groupBy("pair_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("identical", "wording", "substantive", "added", "removed")))


