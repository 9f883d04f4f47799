"""Rank fusion and the merge of looked-up provisions into a ranked list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAMPING = 60


def reciprocal_rank_fusion(lists: list[DataFrame], *, damping: int = DAMPING, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank, retriever) from ranked lists, the first list winning ties.

    The score is the sum of 1 / (damping + rank) over the lists that hold a chunk. Ties go by the
    rank in the first list, then in the next. ``retriever`` joins the sorted names with ``+``.
    Rows without a rank are left out; of repeated rows of a list the best rank counts.
    """
    named = [x.select("query_id", "chunk_id", "rank", "retriever", F.lit(i).alias("_list")) for i, x in enumerate(lists)]
    every = reduce(DataFrame.unionByName, named).filter("rank is not null")
    # one pass: the best rank in each list as its own column
    best = every.groupBy("query_id", "chunk_id").agg(
        *(F.min(F.when(F.col("_list") == i, F.col("rank"))).alias(f"_r{i}") for i in range(len(lists))),
        F.array_join(F.array_sort(F.collect_set("retriever")), "+").alias("retriever"),
    )
    score = reduce(lambda a, b: a + b, (F.coalesce(F.lit(1.0) / (F.lit(float(damping)) + F.col(f"_r{i}")), F.lit(0.0)) for i in range(len(lists))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(F.col(f"_r{i}").asc_nulls_last() for i in range(len(lists))), "chunk_id")
    ranked = best.withColumn("score", F.round(score, 12)).withColumn("rank", F.row_number().over(order))
    if k is not None:
        ranked = ranked.filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "score", "rank", "retriever")


def prioritise(looked_up: DataFrame, ranked: DataFrame, *, k: int | None = None) -> DataFrame:
    """Looked-up provisions (query_id, chunk_id, ord) first, with score 1 and tag ``citation``; then the ranked rest."""
    head = looked_up.select("query_id", "chunk_id", F.lit(1.0).alias("score"), F.col("ord").cast("int").alias("_o"), F.lit("citation").alias("retriever"), F.lit(0).alias("_src"))
    rest = ranked.join(looked_up.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    rest = rest.select("query_id", "chunk_id", "score", F.col("rank").alias("_o"), "retriever", F.lit(1).alias("_src"))
    order = Window.partitionBy("query_id").orderBy("_src", "_o", "chunk_id")
    out = head.unionByName(rest).withColumn("rank", F.row_number().over(order))
    if k is not None:
        out = out.filter(F.col("rank") <= k)
    return out.select("query_id", "chunk_id", "score", "rank", "retriever")


def by_authority(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extension, off by default: the same rows ordered by score, then authority weight, then rank."""
    weights = chunks.select("chunk_id", "authority_weight")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("authority_weight"), "_old")
    out = ranked.join(weights, "chunk_id", "left").withColumnRenamed("rank", "_old").withColumn("rank", F.row_number().over(order))
    return out.select("query_id", "chunk_id", "score", "rank", "retriever", "authority_weight")


def in_force(ranked: DataFrame, chunks: DataFrame, years: DataFrame) -> DataFrame:
    """Extension, off by default: only chunks whose span of years holds the query's; open ends hold all."""
    spans = chunks.select("chunk_id", "tax_year_start", "tax_year_end")
    out = ranked.join(spans, "chunk_id").join(years.select("query_id", "tax_year"), "query_id")
    lo, hi = F.least("tax_year_start", "tax_year_end"), F.greatest("tax_year_start", "tax_year_end")
    holds = F.col("tax_year").isNull() | ((F.col("tax_year_start").isNull() | (F.col("tax_year") >= lo)) & (F.col("tax_year_end").isNull() | (F.col("tax_year") <= hi)))
    return out.filter(holds).select("query_id", "chunk_id", "score", "rank", "retriever")
