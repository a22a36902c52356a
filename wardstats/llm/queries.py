"""The registered opN_<name> queries: thin digests over the operators, with
their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstats.llm import html, neighbours, sql
from wardstats.llm.brown import log_probabilities
from wardstats.llm.decontaminate import best_overlaps
from wardstats.llm.jaccard import near_duplicates
from wardstats.llm.licenses import scan
from wardstats.llm.packing import minimum_bin_slack, token_pieces
from wardstats.llm.quality import judge_quality
from wardstats.llm.phrases import digest, repeated_bytes
from wardstats.llm.scratch import table
from wardstats.llm.search import rank_documents
from wardstats.llm.spelling import variants
from wardstats.llm.toxicity import fit, toxicity
from wardstats.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: A row's class model, learned rules, tokens, ranks and learned weights have no
#: SQL; tests/llm holds those queries against brute force.
ORACLES: dict[str, str] = {"op1_licenses": sql.licenses(), "op3_jaccard": sql.JACCARD, "op10_repeats": sql.REPEATS,
                           "op11_spelling": sql.SPELLING, "op13_search": sql.SEARCH}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimum_bin_slack(token_pieces(table(spark, sf_dir, "documents"), 2048), 2048)


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = [F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("row.doc_id", *counts, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"))


@_query
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 5, 80)


@_query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(repeated_bytes(table(spark, sf_dir, "documents"), 50))


def _held_out(parts: int, one: int):
    """Whether a row's id falls into the part that no fit may see."""
    return F.crc32(F.col("doc_id").cast("string")) % parts == one


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = fit(docs, labels.where(~_held_out(3, 1)))
    return toxicity(docs, machine).select(
        "doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_terms")


@_query
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@_query
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.main_text(pages, html.fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_probabilities(table(spark, sf_dir, "documents"), _held_out(7, 2))


@_query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), 5, 3, slip=97)


@_query
def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fitted = neighbours.fit(docs, labels.where(~_held_out(3, 1)))
    return neighbours.judge(docs, fitted).select(
        "doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)
