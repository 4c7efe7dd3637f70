"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm import (
    chunks,
    decontam,
    html_text,
    licences,
    line_templates,
    merkle,
    negatives,
    packing,
    quality,
    quotes,
    simhash,
    sql,
    suffixes,
    tokens,
)
from tablepulse.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_length_buckets(spark, folder):
    """Tokens are words here; ``packing.pack`` takes any count."""
    return packing.pack(table(spark, folder, "documents"))


def op2_viterbi_counts(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents"))


def op3_gear_chunks(spark, folder):
    return chunks.whole_passages(table(spark, folder, "documents")).drop("text_hash")


def op4_line_blocks(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


def op5_simhash_anchors(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_positional_index(spark, folder):
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontam.contamination(docs, benchmark).drop("text_hash")


def op7_quotation_links(spark, folder):
    return quotes.reply_order(table(spark, folder, "conversations"))


def op8_quality_cascade(spark, folder):
    return quality.quality_report(table(spark, folder, "documents"))


def op9_licence_digests(spark, folder):
    return licences.scan(table(spark, folder, "documents"), licences.known_licences(spark))


def op10_line_templates(spark, folder):
    return line_templates.line_report(table(spark, folder, "documents"))


def op11_merkle_intervals(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"))


def op12_suffix_merge(spark, folder):
    left = suffixes.without_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_slot_negatives(spark, folder):
    return negatives.hard_negatives(table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_length_buckets,
        op2_viterbi_counts,
        op3_gear_chunks,
        op4_line_blocks,
        op5_simhash_anchors,
        op6_positional_index,
        op7_quotation_links,
        op8_quality_cascade,
        op9_licence_digests,
        op10_line_templates,
        op11_merkle_intervals,
        op12_suffix_merge,
        op13_slot_negatives,
    )
}

# The others are tested against brute force: SQL has no dynamic programming over histograms or vocabularies, gear hash,
# page parser, XXH64, or threads of unbounded depth.
ORACLE_SQL: dict[str, str] = {
    "op6_positional_index": sql.contamination_sql(),
    "op8_quality_cascade": sql.quality_sql(),
    "op9_licence_digests": sql.licence_sql(),
    "op10_line_templates": sql.template_sql(),
    "op11_merkle_intervals": sql.manifest_sql(),
    "op12_suffix_merge": sql.repeats_sql(),
    "op13_slot_negatives": sql.negatives_sql(),
}
