"""Search: BM25, nearest neighbours, fused and ranked results, evidence packets.

A search over documents that aren't indexed is one scan for the figures of the corpus and one for the scores, both with
the columns they need and nothing shuffled but one row per task. Over an index it reads the postings of its terms only.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T

#: Constants of BM25 and of reciprocal rank fusion, and the boosts of the ranker.
K1, B, FLOOR = 1.2, 0.75, 1e-6
RRF_K, RRF_SCALE = 60, 5.0
IN_NAME, IN_PATH, SAME_KIND, HAS_ENTITY, RECENT, RECENT_DAYS = 5.0, 1.0, 3.0, 2.0, 2.0, 365.0
MAX_SOURCES, MAX_TEXT, MAX_FIELDS, LOW_CONFIDENCE = 8, 4000, 8, 0.6

#: Words of a query that tell which kind of document is wanted.
KIND_HINTS = (
    (r"請求書|invoice|請求|billing", "pdf"),
    (r"領収書|receipt", "pdf"),
    (r"見積|estimate|quote|quotation", "pdf"),
    (r"契約書?|contract|agreement|NDA", "pdf"),
    (r"スプレッドシート|spreadsheet|excel|エクセル", "xlsx"),
    (r"プレゼン|スライド|slide|powerpoint", "pptx"),
    (r"議事録|meeting notes|minutes", "docx"),
)


def kind_preference(text: str) -> str | None:
    return next((kind for pattern, kind in KIND_HINTS if re.search(pattern, text, re.IGNORECASE)), None)


def over_fetch(limit: int) -> int:
    return max(4 * limit, 40)


# ---- BM25


def phrases(query: str) -> list[tuple[str, bool]]:
    """Each term once exact and once as a prefix: an exact hit counts in both."""
    return [(t, prefix) for t in T.query_tokens(query) for prefix in (False, True)]


def _spaced(text: Column) -> Column:
    """The tokens of a text with one space at either end of each, so that two are between any two."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(T.fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))


def _times(spaced: Column, part: str) -> Column:
    """How often a spaced text holds a part that can't overlap itself; strings are replaced and measured, without a lambda per token."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _once(value: Column) -> Column:
    """The value by way of a generator: filters and projections above take it as it is, instead of working it out each time they name it."""
    return F.explode(F.array(value))


def _hits(spaced: Column, term: str, prefix: bool) -> Column:
    return _times(spaced, f" {term}" if prefix else f" {term} ")


def _length(spaced: Column) -> Column:
    return F.when(F.length(spaced) > 2, _times(spaced, "  ") + 1).otherwise(0)


def _weight(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf)
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))).otherwise(0.0)


def bm25(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The rows that hold a term, with ``score`` (higher is better). Figures are of the whole corpus."""
    wanted = phrases(query)
    if not wanted:
        return docs.filter("false").withColumn("score", F.lit(0.0))
    found = docs.select("*", _once(_spaced(F.col(text))).alias("_spaced"))
    found = found.select("*", _length(F.col("_spaced")).alias("_length"), F.array(*(_hits(F.col("_spaced"), t, p) for t, p in wanted)).alias("_tf")).drop("_spaced")
    stats = found.agg(
        F.count("*").cast("double").alias("_n"),
        F.avg("_length").alias("_average"),
        F.array(*(F.count_if(F.col("_tf")[k] > 0).cast("double") for k in range(len(wanted)))).alias("_df"),
    )
    score = reduce(lambda a, b: a + b, (_weight(F.col("_tf")[k], F.col("_df")[k], F.col("_n"), F.col("_length"), F.col("_average")) for k in range(len(wanted))))
    hit = found.filter(F.exists("_tf", lambda x: x > 0))
    return hit.join(F.broadcast(stats)).withColumn("score", score).drop("_length", "_tf", "_n", "_average", "_df")  # one row of figures


def postings(docs: DataFrame, key: str | tuple[str, ...] = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The inverted index: (term, key, tf), and (key, length)."""
    keys = (key,) if isinstance(key, str) else key
    spaced = F.trim(_spaced(F.col(text)))
    each = docs.select(*keys, F.explode(F.split(spaced, "  ")).alias("term")).filter("term <> ''")
    return each.groupBy("term", *keys).agg(F.count("*").alias("tf")), docs.select(*keys, _once(_spaced(F.col(text))).alias("_spaced")).select(*keys, _length(F.col("_spaced")).alias("length"))


def bm25_indexed(index: DataFrame, lengths: DataFrame, query: str, key: str = "doc_id", *more: str) -> DataFrame:
    """(key, more columns of lengths, score) over an index. The filters on term reach the scan of a stored index."""
    wanted = phrases(query)
    if not wanted:
        return lengths.filter("false").select(key, *more, F.lit(0.0).alias("score"))
    test = lambda t, p: F.col("term").startswith(t) if p else F.col("term") == t
    every = reduce(lambda a, b: a | b, (test(t, p) for t, p in wanted))
    of = F.array_compact(F.array(*(F.when(test(t, p), F.lit(k)) for k, (t, p) in enumerate(wanted))))
    tf = index.filter(every).select(key, "tf", F.explode(of).alias("phrase")).groupBy(key, "phrase").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("phrase").agg(F.count("*").cast("double").alias("df"))
    stats = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("average"))
    scored = tf.join(F.broadcast(df), "phrase").join(lengths.select(key, *more, "length"), key).join(F.broadcast(stats))  # as many rows as phrases, and one
    return scored.groupBy(key, *more).agg(F.sum(_weight(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("average"))).alias("score"))


# ---- vectors


def nearest(vectors: DataFrame, target: list[float], limit: int, key: str = "chunk_id", where: Column | None = None) -> DataFrame:
    """The ``limit`` vectors of the target's dimension that are nearest: all columns but the vector, and distance."""
    rows = vectors.filter(F.size("embedding") == len(target))
    rows = rows if where is None else rows.filter(where)
    goal = F.array(*(F.lit(float(x)) for x in target))
    return rows.withColumn("distance", T.distance(F.col("embedding"), goal)).drop("embedding").orderBy("distance", key).limit(max(1, limit))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Places from 1 in a list that a limit has already bounded."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def fuse(lists: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal rank fusion of lists of (key, rank) that limits have bounded: (key, rrf), nothing if one is empty. Each list is read once."""
    both = reduce(DataFrame.unionByName, (x.select(key, "rank", F.lit(k).alias("list")) for k, x in enumerate(lists)))
    full = F.size(F.collect_set("list").over(Window.partitionBy(F.lit(0)))) == len(lists)
    return both.withColumn("full", full).filter("full").groupBy(key).agg(F.sum(RRF_SCALE / (RRF_K + F.col("rank"))).alias("rrf"))


# ---- recall and ranking


def entity_terms(query: str, shortest: int = 3, most: int = 5) -> list[str]:
    return [t for t in query.split() if len(t) >= shortest][:most]


def entity_grams(entities: DataFrame) -> DataFrame:
    """The index of what entities hold: (gram, low, document_id), one row for each three characters of an entity's text in lower case, and for
    the one or two at its end. So every character of a text begins a gram, and a term of any length begins one wherever it
    stands. Entities are short; a text is repeated as often as it has characters."""
    low = entities.select("document_id", F.lower("text").alias("low")).filter("low <> ''").distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low")), lambda k: F.substring("low", k, 3)))
    return low.select(F.explode(grams).alias("gram"), "low", "document_id")


def _gram_of(grams: DataFrame, terms: list[str]) -> dict[str, str]:
    """For each term the gram that fewest rows have; one look at the lists of all their grams."""
    own = {t: sorted({t[k : k + 3] for k in range(len(t) - 2)}) for t in terms if len(t) >= 3}
    every = sorted({g for gs in own.values() for g in gs})
    found = {r.gram: r.n for r in grams.filter(F.col("gram").isin(*every)).groupBy("gram").agg(F.count("*").alias("n")).collect()} if every else {}
    return {t: min(gs, key=lambda g: (found.get(g, 0), g)) for t, gs in own.items()}


def entity_documents_indexed(grams: DataFrame, query: str, docs: DataFrame | None = None, per_term: int = 20, shortest: int = 3) -> DataFrame:
    """As ``entity_documents``, from the index: of each term the list of its rarest gram is read and verified, of a term of one or two
    characters the lists of the grams that begin with it, which hold nothing else. The filters on gram reach the scan of a stored index,
    which is sorted by it. ``docs`` (document_id) restricts the documents."""
    terms = entity_terms(query, shortest)
    if not terms:
        return grams.filter("false").select(F.lit("").alias("term"), F.lit(0).alias("pos"), "document_id")
    low = [t.lower() for t in terms]
    rarest = _gram_of(grams, low)
    tests = [(F.col("gram") == rarest[t]) & F.col("low").contains(t) if t in rarest else F.col("gram").startswith(t) for t in low]
    hit = grams.filter(reduce(lambda a, b: a | b, tests))
    said = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(t).alias("term"), F.lit(k).alias("pos"))) for k, (t, test) in enumerate(zip(terms, tests)))))
    hit = hit.select("document_id", F.explode(said).alias("s")).select("s.term", "s.pos", "document_id").distinct()
    hit = hit if docs is None else hit.join(docs, "document_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("pos").orderBy("document_id"))  # Spark keeps the first few of each task before it deals them
    return hit.withColumn("place", place).filter(F.col("place") <= per_term).select("term", "pos", "document_id")


def entity_documents(entities: DataFrame, query: str, per_term: int = 20) -> DataFrame:
    """(term, pos, document_id): for each of the first five terms of three or more characters, the first documents, by id,
    with an entity that holds it."""
    terms = entity_terms(query)
    if not terms:
        return entities.filter("false").select(F.lit("").alias("term"), F.lit(0).alias("pos"), "document_id")
    said = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(k).alias("pos")) for k, t in enumerate(terms)))
    hit = entities.select("document_id", F.explode(F.filter(said, lambda s: F.lower("text").contains(F.lower(s["term"])))).alias("s"))
    place = F.row_number().over(Window.partitionBy("pos").orderBy("document_id"))  # Spark keeps the first few of each task before it deals them
    return hit.select("s.term", "s.pos", "document_id").distinct().withColumn("place", place).filter(F.col("place") <= per_term).drop("place")


def in_period(rows: DataFrame, since: datetime | None, until: datetime | None) -> DataFrame:
    """Rows whose mtime is within the bounds there are."""
    tests = [F.col("mtime") >= F.lit(since)] * (since is not None) + [F.col("mtime") <= F.lit(until)] * (until is not None)
    return reduce(DataFrame.filter, tests, rows)


def within_budget(chunks: DataFrame, most: int, by: str = "document_id", order: str = "ordinal", size: str = "char_count") -> DataFrame:
    """The first chunks of each document, as many whole ones as have ``most`` characters together; with ``running``, their sum so far."""
    running = F.sum(size).over(Window.partitionBy(by).orderBy(order))
    return chunks.withColumn("running", running).filter(F.col("running") <= most)


def rank(
    candidates: DataFrame,
    query: str,
    as_of: datetime,
    kind: str | None = None,
    period: tuple[datetime | None, datetime | None] = (None, None),
    period_note: str | None = None,
) -> DataFrame:
    """The best chunk of each document, with score, reason and matched_terms.

    ``candidates`` has document_id, chunk_id (null for a hit on a file name), name, path, kind, mtime, text, raw (lower is
    better), entity_term (the term an entity of the document holds, or null), semantic (boolean) and rrf."""
    terms = [t for t in re.split(r"\s+", query.lower()) if t]
    kind = kind or kind_preference(query)
    rows = in_period(candidates, *period)
    low = {c: F.lower(c) for c in ("name", "path", "text")}
    said = F.array(*(F.lit(t) for t in terms)).cast("array<string>")
    matched = F.filter(said, lambda t: low["text"].contains(t))
    in_name = F.filter(said, lambda t: low["name"].contains(t))
    in_path = F.filter(said, lambda t: low["path"].contains(t) & ~low["name"].contains(t))
    same = F.col("kind").eqNullSafe(F.lit(kind)) if kind else F.lit(False)
    age = F.greatest(F.lit(0.0), (F.lit(as_of).cast("timestamp").cast("double") - F.col("mtime").cast("double")) / 86400.0)
    fresh = F.greatest(F.lit(0.0), RECENT * (1 - F.least(age, F.lit(RECENT_DAYS)) / RECENT_DAYS))
    base = (
        -F.col("raw")
        + IN_NAME * F.size(in_name)
        + IN_PATH * F.size(in_path)
        + F.when(same, SAME_KIND).otherwise(0.0)
        + F.when(F.col("entity_term").isNotNull(), HAS_ENTITY).otherwise(0.0)
        + fresh
    )
    floored = F.when(F.col("semantic") & (F.size(matched) == 0), F.greatest(base, F.lit(1.0))).otherwise(base)
    rrf = F.coalesce("rrf", F.lit(0.0))
    reasons = F.flatten(
        F.array(
            F.transform(in_name, lambda t: F.concat(F.lit("filename ~ '"), t, F.lit("'"))),
            F.array_compact(
                F.array(
                    F.when(same, F.lit(f"kind == {kind}")),
                    F.when(F.col("entity_term").isNotNull(), F.concat(F.lit("entity ~ '"), "entity_term", F.lit("'"))),
                    F.when(fresh > 0.5, F.lit("recent")),
                    F.lit(period_note),
                    F.when(F.col("semantic"), F.lit("semantic")),
                    F.when(rrf > 0, F.concat(F.lit("rrf="), F.format_number(rrf, 2))),
                )
            ),
        )
    )
    scored = rows.select(
        "*",
        (floored + rrf).alias("score"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("fts match").alias("reason"),
        matched.alias("matched_terms"),
    )
    best = F.max_by(F.struct(*scored.columns), F.struct(F.col("score"), F.coalesce("chunk_id", F.lit("")).alias("tie")))
    return scored.groupBy("document_id").agg(best.alias("best")).select("best.*")  # combined map-side, unlike a window


def candidates(docs: DataFrame, chunks: DataFrame, hits: DataFrame, known: DataFrame | None, semantic: DataFrame | None = None) -> DataFrame:
    """Recall lists joined to what ``rank`` needs: ``hits`` (chunk_id, score), ``semantic`` (chunk_id, distance), ``known`` (term, pos,
    document_id) of documents with entities (their first chunk), and, if all are empty, documents whose name holds a term."""
    words = ranked(hits.select("chunk_id", "score"), F.desc("score"), F.col("chunk_id"))
    listed = words.select("chunk_id", (-F.col("score")).alias("raw"), F.lit(0).alias("source"))
    if semantic is not None:
        near = ranked(semantic.select("chunk_id", "distance"), F.col("distance"), F.col("chunk_id"))
        listed = listed.unionByName(near.select("chunk_id", F.col("distance").alias("raw"), F.lit(1).alias("source")))
        rrf, flags = fuse([words, near], "chunk_id"), near.select("chunk_id", F.lit(True).alias("semantic"))
    known = docs.filter("false").select(F.lit("").alias("term"), F.lit(0).alias("pos"), "document_id") if known is None else known
    boost = known.groupBy("document_id").agg(F.min_by("term", "pos").alias("entity_term"))  # per_term of each term at most
    some = F.broadcast(boost.select("document_id"))
    firsts = chunks.join(some, "document_id").groupBy("document_id").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id"))
    listed = listed.unionByName(firsts.select("chunk_id", F.lit(-0.5).alias("raw"), F.lit(2).alias("source")))
    listed = listed.groupBy("chunk_id").agg(F.min_by("raw", "source").alias("raw"))
    rows = listed.join(chunks.select("chunk_id", "document_id", "text"), "chunk_id").join(docs.select("document_id", "name", "path", "kind", "mtime"), "document_id")
    rows = rows.join(boost, "document_id", "left")
    if semantic is None:
        return rows.withColumns({"semantic": F.lit(False), "rrf": F.lit(None).cast("double")})
    return rows.join(rrf, "chunk_id", "left").join(flags, "chunk_id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(False)))


def by_file_name(docs: DataFrame, query: str) -> DataFrame:
    """The fallback when nothing else is found: candidates whose name holds a term, with the raw score 999."""
    terms = F.array(*(F.lit(t) for t in query.lower().split())).cast("array<string>")
    hit = docs.filter(F.exists(terms, lambda t: F.lower("name").contains(t)))
    return hit.select(
        "document_id", F.lit(None).cast("string").alias("chunk_id"), "name", "path", "kind", "mtime", F.col("name").alias("text"), F.lit(999.0).alias("raw"),
        F.lit(None).cast("string").alias("entity_term"), F.lit(False).alias("semantic"), F.lit(None).cast("double").alias("rrf"),
    )


# ---- evidence


def suggested_action(kind: Column, intent: str) -> Column:
    """What to do with a source, by the words of the intent, then by its kind."""
    low = intent.lower()
    for words, action in (
        (("請求", "invoice"), "read its fields into the table of invoices"),
        (("契約", "contract"), "set its clauses against those of another version"),
        (("メール", "email", "返信"), "sum up the letters so far, then draft an answer"),
    ):
        if any(w in low for w in words):
            return F.lit(action)
    return F.when(kind == "xlsx", "quote it by sheet and cells").when(kind == "pdf", "quote it by page")


def evidence(results: DataFrame, fields: DataFrame, intent: str, most: int = MAX_SOURCES, longest: int = MAX_TEXT) -> DataFrame:
    """The sources of a packet, best first. ``results`` has document_id, workspace_id, name, path, kind, chunk_id, text,
    confidence, extraction_method, score, reason and perhaps locator; ``fields`` document_id, key, value, confidence."""
    top = ranked(results.orderBy(F.desc("score"), "document_id").limit(most), F.desc("score"), F.col("document_id"))
    own = F.sort_array(F.collect_list(F.struct("key", "value", F.col("confidence").alias("field_confidence"))))
    some = fields.join(F.broadcast(top.select("document_id")), "document_id").groupBy("document_id").agg(F.slice(own, 1, MAX_FIELDS).alias("fields"))  # at most ``most`` rows
    low = F.format_string("%s (%s) confidence=%.2f", "name", "extraction_method", "confidence")
    return top.join(some, "document_id", "left").select(
        F.col("rank").alias("position"),
        F.coalesce("chunk_id", F.concat("document_id", F.lit(":doc"))).alias("source_id"),
        "document_id", "workspace_id", F.col("path").alias("file_path"), F.col("name").alias("file_name"), F.col("kind").alias("file_type"),
        T.shortened(F.col("text"), longest).alias("extracted_text"),
        (F.length("text") > longest).alias("truncated"),
        F.coalesce("fields", F.array().cast("array<struct<key:string,value:string,field_confidence:double>>")).alias("fields"),
        F.col("score").alias("relevance_score"), F.col("confidence").alias("confidence_score"), "reason",
        (F.col("locator") if "locator" in results.columns else F.lit("")).alias("locator"),
        F.when(F.col("confidence") < LOW_CONFIDENCE, low).alias("low_confidence"),
        suggested_action(F.col("kind"), intent).alias("suggested_action"),
    )


def packet(sources: DataFrame, intent: str) -> DataFrame:
    """One row: the packet with its sources, workspaces and items of low confidence."""
    return sources.agg(
        F.sort_array(F.collect_list(F.struct(*sources.columns))).alias("sources"),
        F.sort_array(F.collect_set("workspace_id")).alias("workspace_ids"),
        F.collect_list("low_confidence").alias("low_confidence_items"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
    ).withColumn("intent", F.lit(intent))
