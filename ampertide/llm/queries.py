"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_forest, chat, chunk_bpe, content_sort, filter_audit, maxent, packing, ranked_ids, simhash, token_counts, toxicity, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return wrap


@query("op1_warc_revisits", warc.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query("op2_length_histogram")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


@query("op3_maxent_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.maxent_scores(table(spark, sf_dir, "documents"))


@query("op4_prefix_forest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"))


@query("op5_chat_round_trip", chat.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations")))
    return chat.chat_digests(chat.read_chats(formatted))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op7_chunked_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_documents(table(spark, sf_dir, "documents"))


@query("op8_sum_of_squares_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op9_toxicity_chain")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_content_sort", content_sort.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_groups(table(spark, sf_dir, "documents"))


@query("op13_filter_audit", filter_audit.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_ranked_ids")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_ids.id_file_round_trip(table(spark, sf_dir, "documents"))


@query("op12_chebyshev_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
