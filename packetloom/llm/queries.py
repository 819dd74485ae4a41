"""The operators' queries over the whole given tables, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm.context_tree import lm_scores
import corpus_pipeline
from packetloom.llm import fill_middle, fp_search, licenses
from packetloom.llm.cross_polytope import near_vectors
from packetloom.llm.decontaminate import benchmark_matches
from packetloom.llm.mixing import mix_sources
from packetloom.llm.ngram_join import jaccard_components
from packetloom.llm.pii import pii_spans
from packetloom.llm.quality import quality_verdicts
from packetloom.llm.tables import load
from packetloom.llm.token_counts import token_counts
from packetloom.llm.warc import warc_round_trip
from packetloom.llm.wrappers import main_texts

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(load(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(load(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), TOKENIZER)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_round_trip(load(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(load(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(load(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_search.ranked_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle_digests(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_html_extraction, op2_benchmark_decontamination, op3_source_mixing, op4_license_scan, op5_token_counts, op6_warc,
    op7_ngram_jaccard_join, op8_quality_rules, op9_pii, op10_lm_scoring, op11_embedding_near_dedup, op12_ranked_search,
    op13_fill_in_middle)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {
    "op4_license_scan": licenses.oracle_sql(),
    "op12_ranked_search": fp_search.oracle_sql(),
    "op13_fill_in_middle": fill_middle.oracle_sql(),
}
