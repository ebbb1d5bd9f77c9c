"""The history of a client: its documents by bucket, its totals by currency, its timeline."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from corpuslens.functions import money
from corpuslens.operators import search

#: Forms of companies, and what names of files tell about their bucket.
JP_FORMS = ("株式会社", "有限会社", "合同会社", "合名会社", "合資会社", "社団法人", "財団法人", "一般社団法人", "一般財団法人")
EN_FORM = r"[,\s]+(?:Inc\.?|LLC|Ltd\.?|Limited|Corp\.?|Corporation|GmbH|S\.A\.|K\.K\.|Co\.,?\s*Ltd\.?)\s*$"
BUCKET_NAMES = (("invoice", r"請求書|invoice|billing", "/invoices/"), ("contract", r"契約|nda|agreement|contract|覚書", "/contracts/"))
EMAIL_NAME = r"\.eml$|\.msg$|mail|メール"
SHORTEST_ALIAS, TIMELINE = 2, 50
#: So many beginnings of aliases (three characters, with the lengths of aliases) go to all tasks; more are joined by a shuffle.
FEW_BEGINS = 100_000


#: Rules that give another spelling of a name, in their order: what the name must hold, and what is cut out of it.
SPELLINGS = (
    *((form, cut) for form in JP_FORMS for cut in (form, f"{form}| ")),
    (EN_FORM, EN_FORM),
    ("@", "@.*"),
    ("@", "^[^@]*@"),
    (r"@|^[^ ]*\.[^ ]*$", r"^[^@]*@|\.[^@]*$"),
)


def aliases(name: str, extra: list[str] | None = None) -> list[str]:
    """Spellings under which a client may occur: without the form of the company, parts of e-mail addresses and domains."""
    given = [(x or "").strip() for x in (name, *(extra or []))]
    spelled = [[x, *(re.sub(cut, "", x, flags=re.IGNORECASE).strip() for holds, cut in SPELLINGS if re.search(holds, x, re.IGNORECASE))] for x in given]
    long = [x for own in spelled for x in own if len(x) >= SHORTEST_ALIAS]
    return list({x.lower(): x for x in reversed(long)}.values())[::-1]


def _first_alias(text: Column, names: list[str]) -> Column:
    """The first alias that a text holds, ignoring case, or null."""
    return F.coalesce(*(F.when(F.lower(text).contains(n.lower()), F.lit(n)) for n in names), F.lit(None).cast("string"))


def recall(docs: DataFrame, entities: DataFrame, names: list[str]) -> DataFrame:
    """(document_id, alias, via) of documents with an entity that holds an alias, else with one in name or path. One pass over
    each table; documents meet once, by id."""
    if not names:
        return docs.filter("false").select("document_id", F.lit("").alias("alias"), F.lit("").alias("via"))
    pos = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))))
    by_entity = entities.select("document_id", _first_alias(F.col("text"), names).alias("alias"), F.lit(0).alias("way"))
    by_name = docs.select("document_id", _first_alias(F.concat_ws("\n", "name", "path"), names).alias("alias"), F.lit(1).alias("way"))
    hit = by_entity.unionByName(by_name).filter(F.col("alias").isNotNull())
    best = hit.groupBy("document_id").agg(F.min(F.struct("way", pos[F.col("alias")].alias("pos"), "alias")).alias("b"))
    return best.select("document_id", "b.alias", F.when(F.col("b.way") == 0, "entity").otherwise("filename").alias("via"))


def spelled(clients: DataFrame) -> DataFrame:
    """client_id, pos, alias: the spellings of each client, in order. ``clients`` has client_id, name and perhaps extra (array of strings)."""

    @F.pandas_udf("array<string>")
    def spell(name: pd.Series, extra: pd.Series) -> pd.Series:
        return pd.Series([aliases(n, [] if e is None else [x for x in e if x is not None]) for n, e in zip(name, extra)])

    extra = F.col("extra") if "extra" in clients.columns else F.lit(None).cast("array<string>")
    return clients.select("client_id", F.posexplode(spell("name", extra)).alias("pos", "alias"))


def recall_all(docs: DataFrame, grams: DataFrame, clients: DataFrame) -> DataFrame:
    """(client_id, document_id, alias, via) of all clients in one pass: as ``recall`` of each. ``grams`` is the index of entities
    (search.entity_grams); names and paths are indexed alike. Rows of the index whose gram begins an alias give the parts of their text that begin
    so and are as long as such an alias; these are joined to the aliases whole. So no alias is set against a list of texts: the work grows with the
    texts and with what is found, and neither clients nor documents need to fit anywhere."""
    named = search.entity_grams(docs.select("document_id", F.concat_ws("\n", "name", "path").alias("text")))
    index = grams.select("gram", "low", "document_id", F.lit(0).alias("way")).unionByName(named.withColumn("way", F.lit(1)))
    said = spelled(clients).withColumn("said", F.lower("alias")).filter(F.length("said") >= SHORTEST_ALIAS)
    begins = said.select(F.substring("said", 1, 3).alias("begin"), F.length("said").alias("size")).distinct()
    begins = begins.groupBy("begin").agg(F.collect_list("size").alias("sizes")).persist(StorageLevel.DISK_ONLY)
    few = begins.limit(FEW_BEGINS + 1).count() <= FEW_BEGINS

    def parts(rows: DataFrame, of: DataFrame, test: Column) -> DataFrame:
        at = F.filter(F.sequence(F.lit(1), F.length("low")), lambda k: F.col("low").substr(k, F.length("begin")) == F.col("begin"))
        cut = F.transform(at, lambda k: F.transform("sizes", lambda n: F.when(k + n - 1 <= F.length("low"), F.col("low").substr(k, n))))
        return rows.join(F.broadcast(of) if few else of, test).select(F.explode(F.array_compact(F.array_distinct(F.flatten(cut)))).alias("said"), "document_id", "way")

    long, short = begins.filter(F.length("begin") == 3), begins.filter(F.length("begin") < 3)
    found = parts(index, long, F.col("gram") == F.col("begin"))
    if not short.isEmpty():  # of two characters: the grams that begin with them
        found = found.unionByName(index.join(F.broadcast(short) if few else short, F.substring("gram", 1, 2) == F.col("begin")).select(F.col("begin").alias("said"), "document_id", "way"))
    hit = found.join(said, "said")
    best = hit.groupBy("client_id", "document_id").agg(F.min(F.struct("way", "pos", "alias")).alias("b"))
    return best.select("client_id", "document_id", "b.alias", F.when(F.col("b.way") == 0, "entity").otherwise("filename").alias("via"))


def bucket(name: Column, path: Column, kind: Column, has_invoice_number: Column) -> Column:
    """invoice, contract, email or note, by the first of these that anything speaks for."""
    out = F.when(has_invoice_number, "invoice")
    for label, pattern, folder in BUCKET_NAMES:
        out = out.when(F.lower(path).contains(folder) | F.lower(name).rlike(pattern), label)
    return out.when((kind == "email") | F.lower(name).rlike(EMAIL_NAME), "email").otherwise("note")


def history(docs: DataFrame, entities: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """The client's documents: document_id, alias, via, bucket, currency and amount of the total, mtime, name, path."""
    return _told(recall(docs, entities, names), docs, fields)


def histories(docs: DataFrame, grams: DataFrame, fields: DataFrame, clients: DataFrame) -> DataFrame:
    """The histories of many clients: as ``history`` of each, with client_id."""
    return _told(recall_all(docs, grams, clients), docs, fields, "client_id")


def _told(found: DataFrame, docs: DataFrame, fields: DataFrame, *more: str) -> DataFrame:
    own = fields.groupBy("document_id").agg(
        F.bool_or(F.col("key") == "invoice_number").alias("has_number"), F.max_by(F.when(F.col("key") == "total", F.col("value")), F.when(F.col("key") == "total", F.col("confidence"))).alias("total")
    )
    rows = found.join(docs, "document_id").join(own, "document_id", "left")
    kind = bucket(F.col("name"), F.col("path"), F.col("kind"), F.coalesce("has_number", F.lit(False)))
    worth = money.parse_amount(F.col("total"))
    return rows.select(*more, "document_id", "alias", "via", kind.alias("bucket"), worth["currency"].alias("currency"), worth["amount"].alias("amount"), "mtime", "name", "path")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.count("*").alias("documents"))


def totals(rows: DataFrame) -> DataFrame:
    """One total per invoice, by currency."""
    return rows.filter((F.col("bucket") == "invoice") & F.col("currency").isNotNull()).groupBy("currency").agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("invoices"))


def timeline(rows: DataFrame, limit: int = TIMELINE) -> DataFrame:
    """Newest first."""
    return rows.orderBy(F.desc("mtime"), "document_id").limit(limit)
