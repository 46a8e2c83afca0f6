"""Registered queries of the training-data operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, html_text, language, licenses, line_chunks, mixing, near_dups, quality, repeats, spelling, statements, topk, url_filter
from .common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


@query("op1_source_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain probabilities and fitted rate of every document."""
    return mixing.mix(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op2_substring_dedup", statements.OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that come earlier."""
    return repeats.remove_repeats(documents(spark, sf_dir)).drop("kept_text", "spans")


@query("op3_exact_top_k", statements.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query("op4_html_extraction", statements.OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query("op5_minhash_near_dedup", statements.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return near_dups.near_duplicates(documents(spark, sf_dir), k=3, percent=85)


@query("op6_quality_rules", statements.op6(quality.MAX_COVERED, quality.MAX_DUP_LINE_SHARE, quality.MAX_DUP_LINE_CHARS, quality.MAX_SYMBOLS_PER_WORD,
                                              quality.MAX_UPPER_SHARE, quality.MIN_WORDS))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage of every document, with its verdict."""
    return quality.quality_rules(documents(spark, sf_dir))


@query("op7_line_dedup", statements.OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks of lines that an earlier one holds."""
    return line_chunks.line_dedup(documents(spark, sf_dir))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of both."""
    return bpe.digest_documents(documents(spark, sf_dir))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = documents(spark, sf_dir)
    found = language.label_documents(docs, language.fit(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


#: (verdict, host, path). Fixed values.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query("op10_url_filters")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or learned verdict on the url of every page."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op11_spelling_variants", statements.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their usual spelling."""
    return spelling.variants(documents(spark, sf_dir))


@query("op12_filter_audit", statements.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, for each language."""
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op13_license_scan", statements.op13(licenses.BASE, licenses.NOTICES, licenses.CHARS_PER_EDIT))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document, exact and with errors."""
    return licenses.license_scan(documents(spark, sf_dir)).drop("spans")
