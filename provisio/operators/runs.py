"""Runs of the evaluation: the latest one, what is left to do, and the state of the stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_runs(rows: DataFrame, *, retrieval_only: bool | None = None) -> DataFrame:
    """(config, run_id, last_at): the run with the newest row of each config."""
    if retrieval_only is not None:
        rows = rows.filter(F.coalesce("retrieval_only", F.lit(False)) == retrieval_only)
    return rows.groupBy("config").agg(F.max_by("run_id", F.struct("scored_at", "run_id")).alias("run_id"), F.max("scored_at").alias("last_at"))


def latest_run_file(files: DataFrame, config: str) -> DataFrame:
    """(path): the newest of a config's run files, from (path, modified). Only this config's: ``x_retrievalonly_`` isn't ``x_``."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    own = files.filter(name.rlike(rf"^{config}_\d"))
    return own.agg(F.max_by("path", F.struct("modified", "path")).alias("path")).filter("path is not null")


def remaining(golden: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(config, id): the items that each of ``runs`` (config, run_id) hasn't scored yet."""
    done = rows.join(F.broadcast(runs.select("config", "run_id")), ["config", "run_id"], "left_semi").select("config", "id").distinct()
    due = golden.select("id").join(F.broadcast(runs.select("config")))
    return due.join(done, ["config", "id"], "left_anti").select("config", "id")


def upserted(vectors: DataFrame, *, key: str = "chunk_id", at: str = "embedded_at") -> DataFrame:
    """One row for each key, the latest one; of equal times the largest hash counts."""
    cols = [c for c in vectors.columns if c != key]
    return vectors.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, F.xxhash64(*cols))).alias("r")).select(key, "r.*")


def drift(corpus: DataFrame, vectors: DataFrame, *, key: str = "chunk_id") -> DataFrame:
    """(key, state): ids that only the corpus (``missing``) or only the vectors (``stale``) have."""
    a = corpus.select(key).distinct().withColumn("_a", F.lit(True))
    b = vectors.select(key).distinct().withColumn("_b", F.lit(True))
    out = a.join(b, key, "full_outer").filter("_a is null or _b is null")
    return out.select(key, F.when(F.col("_b").isNull(), F.lit("missing")).otherwise(F.lit("stale")).alias("state"))


def require_no_drift(corpus: DataFrame, vectors: DataFrame, *, key: str = "chunk_id") -> DataFrame:
    """``vectors``, or an error where their ids and the corpus's differ."""
    bad = drift(corpus, vectors, key=key).agg(F.count("*").alias("_bad"))
    checked = vectors.join(F.broadcast(bad))
    message = F.concat(F.lit("ids out of step with the corpus: "), F.col("_bad").cast("string"))
    return checked.filter(F.when(F.col("_bad") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_bad")
