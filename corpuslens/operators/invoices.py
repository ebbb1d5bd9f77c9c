"""Invoice fields: extraction by labels, the best value of each key, and the table of invoices.

All of it is expressions over arrays of lines, within a chunk's row; documents meet in one shuffle, by their id."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import money
from corpuslens.functions import text as T
from corpuslens.operators import diff

#: What values look like.
AMOUNT = (
    r"[¥$€￥£]\s?\d{1,3}(?:[,，]\d{3})*(?:\.\d+)?|\d{1,3}(?:[,，]\d{3})*\s*円|\d+(?:\.\d+)?\s*(?:万円|百万円|億円)"
    r"|(?:USD|JPY|EUR|GBP|CNY)\s*\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?|\d{1,3}(?:[,，]\d{3})+(?:\.\d+)?"
)
DATE = r"\d{4}[-/年]\s?\d{1,2}[-/月]\s?\d{1,2}日?|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}年\d{1,2}月\d{1,2}日?"
NUMBER = r"(?:INV|BILL)[-_/][A-Za-z0-9][A-Za-z0-9\-_/]*|№\s?[A-Za-z0-9\-_/]+|[A-Z]{2,}-\d{4,}(?:-[A-Za-z0-9]+)*"
#: Keys with the type and the look of their values and the labels in front of them, most telling first.
LABELS: tuple[tuple[str, str, str | None, tuple[str, ...]], ...] = (
    ("invoice_number", "id", NUMBER, ("請求書番号", "請求番号", "Invoice No.", "Invoice No", "Invoice #")),
    ("issue_date", "date", DATE, ("請求日", "発行日", "発行年月日", "Invoice Date", "Issue Date", "Date")),
    ("due_date", "date", DATE, ("支払期限", "お支払期限", "お支払い期限", "支払日", "Due Date", "Due", "Payment Due")),
    ("subtotal", "amount", AMOUNT, ("小計", "Subtotal")),
    ("tax", "amount", AMOUNT, ("消費税", "税額", "Tax", "VAT")),
    ("total", "amount", AMOUNT, ("ご請求金額", "請求金額", "請求合計", "合計金額", "合計", "総額", "Total", "Amount Due", "Grand Total")),
    ("recipient", "text", None, ("取引先", "宛先", "請求先", "Bill To", "Billed To", "Customer")),
    ("issuer", "text", None, ("発行元", "発行者", "請求元", "From", "Issued By")),
    ("payment_account", "text", None, ("振込先", "お振込先", "Payment Account", "Bank")),
)
KEYS = tuple(k for k, *_ in LABELS)
COLUMNS = ("invoice_number", "issue_date", "due_date", "issuer", "recipient", "subtotal", "tax", "total", "currency", "payment_account", "source_path", "confidence_avg")
INVOICE_KINDS = ("pdf", "markdown", "xlsx", "docx")
SAME_LINE, NEXT_LINE, INLINE, LOW = 0.95, 0.75, 0.65, 0.70
PREVIEW = 10


def clean(value: Column) -> Column:
    """Without the marks of lists, quotes and brackets in front, and colons behind."""
    return T.strip(F.regexp_replace(F.regexp_replace(value, r"^[\s>*\-•・:：)\]}]+", ""), r"[\s:：]+$", ""))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def _value(text: Column, look: str | None) -> Column:
    return clean(text) if look is None else T.strip(F.regexp_extract(text, f"({look})", 1))


def _same_line(label: str, look: str | None) -> Column:
    """The value behind the label, in the first line that has both."""
    if label.isascii():
        found = rf"(?<![A-Za-z]){re.escape(label)}(?![A-Za-z])"
        tail = lambda line: F.when(line.rlike(f"(?i){found}"), F.regexp_replace(line, f"(?i)^.*?{found}", ""))
    else:
        tail = lambda line: F.when(F.instr(line, label) > 0, F.substring(line, F.instr(line, label) + len(label), F.length(line)))
    having = F.filter("lines", lambda line: F.lower(line).contains(label.lower()))  # few lines have it, and only these are looked at closely
    values = F.transform(having, lambda line: _value(tail(T.strip(line)), look))
    return _first(F.filter(values, lambda v: v != label))


def _next_line(label: str, look: str | None) -> Column:
    """The value in the line after one that is nothing but the label, perhaps as a heading; ``solid`` has no blank lines."""
    here = lambda line: T.strip(F.regexp_replace(line, r"^#+\s*", ""))
    is_label = lambda line: line.contains(label) & ((here(line) == label) | (clean(here(line)) == label))
    follows = F.transform("solid", lambda line, i: F.when(is_label(line), F.get("solid", i + 1)))
    return _first(F.transform(follows, lambda line: _value(clean(line), look)))


def extract(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_id, key, value, value_type, confidence, extractor: at most one value of each key in a chunk."""
    lined = chunks.select("document_id", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), T.lines(F.col("text")).alias("lines"))
    lined = lined.select("*", F.filter("lines", lambda line: T.strip(line) != "").alias("solid"), F.lower("text").alias("low"))

    def field(value: Column, key: str, kind: str, sure: float, how: str) -> Column:
        made = lambda v: F.when(v.isNotNull() & (v != ""), F.struct(F.lit(key).alias("key"), v.alias("value"), F.lit(kind).alias("value_type"), F.lit(sure).alias("confidence"), F.lit(how).alias("extractor")))
        return F.get(F.transform(F.array(value), made), F.lit(0))  # the value is worked out once

    fields = []
    for key, kind, look, labels in LABELS:
        tries = []
        for label in labels:
            there = F.col("low").contains(label.lower())  # most labels are in no line of most texts
            tries.append(F.when(there, field(_same_line(label, look), key, kind, SAME_LINE, "invoice.label")))
            tries.append(F.when(there, field(_next_line(label, look), key, kind, NEXT_LINE, "invoice.section")))
        if key == "invoice_number":
            named = F.col("text").contains("請求書") | F.col("text").contains("Invoice") | F.col("text").contains("INVOICE")
            tries.append(F.when(named, field(T.strip(F.regexp_extract("text", f"({NUMBER})", 1)), key, kind, INLINE, "invoice.heuristic")))
        fields.append(F.coalesce(*tries))
    return lined.select("document_id", "chunk_id", F.explode(F.array_compact(F.array(*fields))).alias("f")).select("document_id", "chunk_id", "f.*")


def best_fields(fields: DataFrame) -> DataFrame:
    """The surest value of each key in a document; the first chunk's of equally sure ones."""
    order = F.struct(-F.col("confidence"), F.col("chunk_id"))
    return fields.groupBy("document_id", "key").agg(F.min_by(F.struct("chunk_id", "value", "value_type", "confidence", "extractor"), order).alias("f")).select("document_id", "key", "f.*")


def summary(best: DataFrame) -> DataFrame:
    """document_id, n_fields, avg_confidence (three digits) and the keys of low confidence."""
    return best.groupBy("document_id").agg(
        F.count("*").alias("n_fields"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
        F.sort_array(F.collect_list(F.when(F.col("confidence") < LOW, F.col("key")))).alias("low_confidence"),
    )


def table(best: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of strings for each document with an invoice number, under COLUMNS, and document_id."""
    pick = lambda k, c: F.max(F.when(F.col("key") == k, F.col(c)))
    wide = best.filter(F.col("key").isin(*KEYS)).groupBy("document_id").agg(*(pick(k, "value").alias(k) for k in KEYS), F.avg("confidence").alias("sure"))
    wide = wide.filter(F.col("invoice_number").isNotNull()).join(docs.select("document_id", F.col("path").alias("source_path")), "document_id")
    currency = money.parse_amount(F.col("total"))["currency"]
    wide = wide.withColumn("currency", currency).withColumn("confidence_avg", F.format_string("%.3f", F.round("sure", 3)))
    return wide.select("document_id", *(F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS))


def skipped(docs: DataFrame, best: DataFrame) -> DataFrame:
    """Documents of an invoice's kinds without an invoice number."""
    return docs.filter(F.col("kind").isin(*INVOICE_KINDS)).join(best.filter(F.col("key") == "invoice_number"), "document_id", "left_anti")


def low_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("confidence_avg").cast("double") < LOW)


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header (a report, of the size of the number of invoices)."""
    out = rows.select(*COLUMNS).orderBy("source_path", "invoice_number").coalesce(1)
    diff.write_single(lambda at: out.write.option("header", True).csv(at), rows.sparkSession, path)


def write_preview(rows: DataFrame, path: str, most: int = PREVIEW) -> str:
    """The first rows of a table beside where it would be written, as ``<stem>.preview.csv``."""
    to = f"{path.removesuffix('.csv')}.preview.csv"
    write_csv(rows.orderBy("source_path", "invoice_number").limit(most), to)
    return to


def write_difference(rows: DataFrame, path: str) -> str:
    """What overwriting a table would change, as ``<stem>.diff.txt`` beside it: a unified difference, or a note that nothing would."""
    to, proposed = f"{path.removesuffix('.csv')}.diff.txt", f"{path}.{uuid.uuid4().hex[:8]}.proposed"
    base = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(proposed)
    try:
        write_csv(rows, proposed)
        diff.write_difference(rows.sparkSession, path, proposed, to)
    finally:
        base.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(base, False)
    return to
