"""Scans and sinks of the retrieval corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provisio.sources.tables import table

CHUNK_SCHEMA = (
    "chunk_id string, text string, citation string, source_type string, authority_weight double, "
    "tax_year_start int, tax_year_end int, url string"
)
GOLDEN_SCHEMA = "id string, category string, question string, draft_citation string, tax_year int, reference_answer string"
WORD_SCHEMA = "doc string, page int, seq int, text string, size double, fontname string, x0 double, top double"


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each key, that of the latest time: rows delivered again count once. Of equal times the smallest hash counts."""
    others = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes if c not in keys]
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*others))
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table, one row for each chunk."""
    return latest(table(spark, folder, "chunks"), ["chunk_id"], "ingested_at")


def chunks_from_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of chunks; ``pos`` is the place in the array."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in CHUNK_SCHEMA.split(', '))}>>").alias("a"))
    return rows.select(F.posexplode("a").alias("pos", "c")).select("c.*", F.col("pos").cast("long").alias("pos"))


def golden_from_json(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """``{"questions": [...]}``; ``limit`` 0 takes all, else the first ones."""
    fields = ", ".join(x.replace(" ", ": ", 1) for x in GOLDEN_SCHEMA.split(", "))
    rows = spark.read.schema(f"questions array<struct<{fields}>>").json(path, multiLine=True)
    rows = rows.select(F.posexplode("questions").alias("pos", "q")).select("q.*", F.col("pos").cast("long").alias("pos"))
    return rows.filter(F.col("pos") < limit) if limit else rows


def registered(files: DataFrame, registry: DataFrame, *, strict: bool = True) -> DataFrame:
    """Files joined to the registry, one small row for each source document.

    ``strict`` raises on a file that isn't registered or has no parser for its suffix.
    """
    known = registry.withColumn("_known", F.lit(True))
    out = files.join(F.broadcast(known), "filename", "left")
    if strict:
        suffix = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
        bad = F.col("_known").isNull() | ~suffix.isin(".html", ".htm", ".pdf")
        out = out.withColumn("_known", F.when(bad, F.raise_error(F.concat(F.lit("no parser or registry entry for "), F.col("filename")))).otherwise(F.col("_known")))
        return out.filter("_known").drop("_known")
    return out.filter("_known").drop("_known")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, html) of a folder of pages; bytes that aren't UTF-8 are left out."""
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content")

    @F.pandas_udf("string")
    def lenient(content):  # noqa: ANN001, ANN202
        return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return raw.select("filename", lenient("content").alias("html"))


def pdf_words(spark: SparkSession, path: str, extractor) -> DataFrame:
    """Words of a folder of PDF files. ``extractor(bytes)`` yields (page, seq, text, size, fontname, x0, top)."""
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("doc"), "content")

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            rows = [(d, *w) for d, c in zip(pdf["doc"], pdf["content"]) for w in extractor(bytes(c))]
            yield pd.DataFrame(rows, columns=["doc", "page", "seq", "text", "size", "fontname", "x0", "top"])

    return raw.mapInPandas(run, WORD_SCHEMA)


def vectors_from_npz(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding) of archives with ``chunk_ids`` and ``embeddings``, one file to a task."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):  # noqa: ANN001, ANN202
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    ids, rows = z["chunk_ids"], z["embeddings"].astype("float32")
                for a in range(0, len(ids), 4096):
                    yield pd.DataFrame({"chunk_id": ids[a : a + 4096].astype(str), "embedding": list(rows[a : a + 4096])})

    return raw.mapInPandas(run, "chunk_id string, embedding array<float>")


def append_rows(df: DataFrame, path: str) -> None:
    """Results by run, appended; a run is continued, not rewritten."""
    df.write.mode("append").partitionBy("config", "run_id").parquet(path)


def scan_registered(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """(filename, doc_pos, kind, content) of the files of a folder, with the registry's columns; ``doc_pos`` is its order.

    A file without a registry entry or a parser for its suffix fails the scan.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content")
    suffix = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    return registered(files, registry).withColumn("kind", F.when(suffix == "pdf", suffix).otherwise(F.lit("html")))


def _versions(spark: SparkSession, path: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("v=")]
    done = [x.getName() for x in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of a vector store."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no vectors in {path}")
    return spark.read.parquet(f"{path}/v={versions[-1]}")


def rebuild_vectors(df: DataFrame, path: str) -> None:
    """Write the rows as the next version; readers of the last one are left alone, and a broken write counts for nothing."""
    versions = _versions(df.sparkSession, path)
    df.write.mode("overwrite").parquet(f"{path}/v={versions[-1] + 1 if versions else 1}")


def upsert_vectors(df: DataFrame, path: str, *, key: str = "chunk_id", at: str = "embedded_at") -> None:
    """Put rows in place of those of the same key, unless these are later; the first rows make the store."""
    spark = df.sparkSession
    every = read_vectors(spark, path).unionByName(df) if _versions(spark, path) else df
    rebuild_vectors(latest(every, [key], at), path)
