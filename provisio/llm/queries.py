"""Registered queries of the operators in this folder, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm import contamination, knn, near_dup, ranking, shared_spans, site_lines, split, tokenize
from provisio.sources.tables import table

TOKENIZERS = os.environ.get("PROVISIO_TOKENIZERS", "/opt/tokenizers")
Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.cut_points(table(spark, d, "chunks", spread=True), limit=1200, overlap=120)


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of half the size, where several boundaries fit and the deepest valley decides."""
    return split.split_pieces(table(spark, d, "chunks", spread=True), limit=600, overlap=60, window=400)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "chunks", spread=True), min_docs=12)


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Lines in at least 12 chunks and one in a hundred of their site taken out."""
    rows = site_lines.without_repeated_lines(table(spark, d, "chunks", spread=True), min_docs=12, min_share=0.01)
    return rows.select("chunk_id", "ingested_at", "clean_text", "lines_removed")


def _criteria(spark: SparkSession, d: str) -> DataFrame:
    return ranking.criteria_from_retrieval(table(spark, d, "retrieved"), table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranking(_criteria(spark, d), top=1).select("query_id", "chunk_id")


def p3_flows(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranking(_criteria(spark, d))


def p3_clipped(spark: SparkSession, d: str) -> DataFrame:
    """The preference grows up to a quarter of the candidates and is whole beyond."""
    flows = ranking.net_flow(_criteria(spark, d), threshold=0.25)
    return flows.withColumn("flow", F.round("flow", 6) + 0.0)  # no negative zero


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.similar_pairs(table(spark, d, "chunk_vectors"), id_col="chunk_id", vec_col="embedding", time_col="embedded_at", k=5, least=0.9)


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest(table(spark, d, "chunk_vectors"), id_col="chunk_id", vec_col="embedding", time_col="embedded_at", k=5)
    return near.withColumn("similarity", F.round("similarity", 5))


NEAR = {"text_col": "text", "group_col": "source_type", "shingle": 3, "num": 1, "den": 2}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(table(spark, d, "chunks", spread=True), **NEAR)


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_links(table(spark, d, "chunks", spread=True), **NEAR)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, d, "documents", spread=True), os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_items(table(spark, d, "documents", spread=True), table(spark, d, "golden_set"))


def p7_edits(spark: SparkSession, d: str) -> DataFrame:
    """Passages with up to two characters changed, left out or put in."""
    return contamination.leaked_items(table(spark, d, "documents", spread=True), table(spark, d, "golden_set"), max_edits=2)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.sharing_pairs(table(spark, d, "documents", spread=True))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.document_shares(table(spark, d, "documents", spread=True))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p2_found, p2_clean, p3_found, p3_flows, p3_clipped, p4_found, p4_neighbours, p5_found, p5_links, p6_ids, p7_found, p7_edits, p8_found, p8_shares)
}
