"""Exact dense top-k: blocks of the corpus against a bounded set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provisio.operators.best import Best

#: Rows of the corpus that are scored together.
BATCH = 2_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, *, dim: int, id_col: str, vec_col: str, query_block: int = 4096) -> DataFrame:
    """(query_id, <id>, score, rank, retriever) by cosine; ``queries`` has (query_id, embedding).

    Each task keeps its own best ``k`` of every query before anything is shuffled, however many
    tie. Queries are sent to the tasks in blocks of ``query_block``, one pass over the
    corpus each. Vectors that are null, of another length, not finite or zero take no part.
    Scores are compared at 9 digits, ties go to the smaller id.
    """
    spark = corpus.sparkSession
    kind, q_kind = dict(corpus.dtypes)[id_col], dict(queries.dtypes)["query_id"]
    fine = lambda c: (F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0)
    text_ids = kind == "string"
    id_type, q_type = (pa.string() if t == "string" else {"int": pa.int32(), "bigint": pa.int64()}.get(t) for t in (kind, q_kind))
    rows = corpus.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<float>").alias("_v")).filter(fine("_v"))
    asked = queries.select("query_id", F.col("embedding").cast("array<float>").alias("_v")).filter(fine("_v"))
    block = asked.toLocalIterator(prefetchPartitions=True)
    out = None
    while True:
        got = [r for _, r in zip(range(query_block), block)]
        if not got and out is not None:
            break
        ids = [r[0] for r in got]
        q = np.array([r[1] for r in got], np.float64).reshape(-1, dim)
        sent = spark.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = Best(len(ids), k)
            for b in batches:
                for a in range(0, b.num_rows, BATCH):
                    x = b.slice(a, BATCH)
                    own = np.array(x.column(0).to_pylist(), object)
                    best.add(own, own if text_ids else own.astype(np.int64), q @ _matrix(x.column(1), dim).T)
            r, own, _, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in r], q_type), pa.array(own.tolist(), id_type), pa.array(score)], names=["query_id", "_id", "score"])

        part = rows.mapInArrow(run, f"query_id {q_kind}, _id {kind}, score double")
        out = part if out is None else out.unionByName(part)
        if len(got) < query_block:
            break
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("_id").alias(id_col), "score", "rank", F.lit("dense").alias("retriever"))
