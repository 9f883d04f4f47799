"""Evaluation runs over a folder of tables, from the command line or as a function.

    python -m provisio.plans.evaluate --data FOLDER --out FOLDER --config hybrid [--limit N] [--resume] [--retrieval-only]
"""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.operators import answer, metrics
from provisio.operators.embed import Embedder, HashingEmbedder, embedded
from provisio.operators.runs import latest_runs, remaining
from provisio.plans.pipeline import ABLATION, retrieve
from provisio.runtime import cut
from provisio.sources.corpus import append_rows, corpus
from provisio.sources.tables import table

ROW = (
    "id string, category string, recall_at_5 double, mrr double, citation_accuracy double, hallucinated_citations array<string>, groundedness int, "
    "premise_correction int, judge_reasoning string, refused boolean, latency_s double, cost_usd double"
)


class RateLimited(RuntimeError):
    """Raised by a generator or judge that may not go on; a run stops after the last whole block."""


def score_items(golden: DataFrame, ranked: DataFrame, chunks: DataFrame, *, generator: answer.Generator, judge: metrics.Judge) -> DataFrame:
    """One scored row for each golden item: retrieval, answer and judgement."""
    asked = golden.select(F.col("id").alias("query_id"), "question")
    said = cut(answer.answers(asked, ranked, chunks, generator))
    context = answer.contexts(ranked, chunks)
    judged = metrics.judge(asked.join(said, "query_id").join(context, "query_id", "left"), judge).withColumnRenamed("query_id", "id")
    held = ranked.join(chunks.select("chunk_id", "citation"), "chunk_id").select("query_id", "citation")
    made_up = metrics.hallucinated(said, held).groupBy(F.col("query_id").alias("id")).agg(F.collect_set("token").alias("hallucinated_citations"))
    accuracy = metrics.citation_accuracy(golden, said.select("query_id", "citations"))
    said = said.select(F.col("query_id").alias("id"), "refused", F.col("trace.latency_s").alias("latency_s"), F.col("trace.cost_usd").alias("cost_usd"))
    out = metrics.retrieval_scores(golden, ranked, chunks).withColumnRenamed("recall", "recall_at_5")
    out = out.join(accuracy, "id").join(said, "id").join(judged, "id").join(made_up, "id", "left")
    return out.withColumn("hallucinated_citations", F.coalesce("hallucinated_citations", F.array().cast("array<string>")))


def as_rows(df: DataFrame) -> DataFrame:
    """All columns of a result row, null where a run doesn't make them."""
    have = set(df.columns)
    return df.select(*(F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in ROW.split(", "))))


def run(
    spark: SparkSession, data: str, out: str, config: str, *, limit: int = 0, resume: bool = False, retrieval_only: bool = False, block: int = 50,
    embedder: Embedder | None = None, generator: answer.Generator | None = None, judge: metrics.Judge | None = None,
) -> DataFrame:
    """Score the golden set under a configuration, append the rows to ``out``, and return the run's summary.

    ``limit`` takes the first items only, 0 all of them. Answers are made and appended by blocks of
    about ``block`` items, so what is paid for is kept if a later block fails; on ``RateLimited`` the
    run ends quietly. ``resume`` goes on with the configuration's latest run of the same kind and
    scores what it lacks; without one it starts anew.
    """
    golden = table(spark, data, "golden_set")
    if limit:
        golden = golden.orderBy("id").limit(limit)
    began = datetime.now(UTC)
    run_id = f"{config}{'_retrievalonly' if retrieval_only else ''}_{began:%Y%m%dT%H%M%SZ}"
    if resume and exists(spark, out):
        before = spark.read.parquet(out).filter(F.col("config") == config)
        last = latest_runs(before, retrieval_only=retrieval_only).collect()  # one row for each configuration
        if last:
            run_id = last[0]["run_id"]
            due = remaining(golden, before, spark.createDataFrame([(config, run_id)], "config string, run_id string"))
            golden = golden.join(cut(due.select("id")), "id", "left_semi")
    golden = cut(golden)
    chunks = cut(corpus(spark, data))
    embedder = embedder or HashingEmbedder()
    vectors = embedded(chunks.select("chunk_id", "text"), embedder).select("chunk_id", "embedding")
    asked = golden.select(F.col("id").alias("query_id"), "question", "tax_year")
    ranked = cut(retrieve(asked, chunks, ABLATION[config], vectors=vectors, embedder=embedder))
    stamp = {"config": F.lit(config), "run_id": F.lit(run_id), "retrieval_only": F.lit(retrieval_only), "scored_at": F.lit(began.replace(tzinfo=None))}
    if retrieval_only:
        scored = metrics.retrieval_scores(golden, ranked, chunks).withColumnRenamed("recall", "recall_at_5")
        append_rows(as_rows(scored).withColumns(stamp), out)
    else:
        blocks = max(1, -(-golden.count() // block))
        for n in range(blocks):
            part = golden.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)
            own = ranked.join(part.select(F.col("id").alias("query_id")), "query_id", "left_semi")
            try:
                scored = score_items(part, own, chunks, generator=generator or answer.ExtractiveGenerator(), judge=judge or metrics.OverlapJudge())
                append_rows(as_rows(scored).withColumns(stamp), out)
            except (PythonException, Py4JJavaError) as e:  # the latter where a checkpoint is being written
                if RateLimited.__name__ not in str(e):
                    raise
                break
    if not exists(spark, out):  # stopped before the first block was whole
        return metrics.run_summaries(spark.createDataFrame([], ROW + ", config string, run_id string"))
    return metrics.run_summaries(spark.read.parquet(out).filter(F.col("run_id") == run_id))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def main() -> None:
    p = argparse.ArgumentParser(description="Score the golden set under a configuration.")
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config", choices=sorted(ABLATION), required=True)
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--resume", action="store_true")
    p.add_argument("--retrieval-only", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("provisio").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(spark, a.data, a.out, a.config, limit=a.limit, resume=a.resume, retrieval_only=a.retrieval_only).show(truncate=False)


if __name__ == "__main__":
    main()
