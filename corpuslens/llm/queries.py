"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import align, chat, dedup, fim, jaccard, licenses, lm, packing, pages, quality, tokens, toxicity

#: Where a vocabulary file is; the operators take its path as a parameter.
TOKENIZERS = public_tokenizers.path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.sql("SELECT -7L AS conv_id, id AS turn, CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(told)
    return chat.digest(chat.expand(rows))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.verdicts(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = TOKENIZERS("byte_bpe_multi_50k.tiktoken")
    return tokens.digest(tokens.encode(_table(spark, sf_dir, "documents"), vocabulary), vocabulary)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.digest(licenses.scan(docs, licenses.fit(docs)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pieces(_table(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count(_table(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.scores(_table(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"), TOKENIZERS("piece_bpe_32k.model"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(_table(spark, sf_dir, "documents")))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_exact_dedup, op3_byte_bpe, op4_toxicity, op5_license_scan, op6_packing, op7_lm_scoring, op8_token_counts, op9_quality_rules, op10_ngram_jaccard,
        op11_cross_tokenizer_alignment, op12_fill_in_middle, op13_html_extraction,
    )
}
