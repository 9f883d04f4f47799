"""Lines repeated across the documents of one site.

Lines are compared by their letters, lower-cased, everything else left out. Per site and line
hash the distinct documents are counted; a line counts as site matter when at least
``min_docs`` documents and at least ``min_share`` of the site's documents hold it. The hits are
joined back to the documents, which are rebuilt without them.

Two 64-bit hashes of a line stand for it. Null texts have no lines; a null url, or one without
http(s), has no site, so its lines are never removed; rows
without an id are kept as they are. Rows of one id count as one document. Columns named
``clean_text`` or ``lines_removed`` are replaced.
Counting runs over (site, line, document) first, so a line that a whole site carries is never
gathered in one task; the join back is salted by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.runtime import cut, over_salts, with_salt

SALTS = 8


def site_of(url: Column) -> Column:
    """Host of an http(s) address: lower case, without user, port and leading ``www.``; else null."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def line_key(line: Column) -> Column:
    """The letters of a line, without case."""
    return F.translate(F.regexp_replace(F.lower(line), r"[^\p{L}]+", ""), "ς", "σ")


def document_lines(docs: DataFrame, id_col: str, text_col: str, url_col: str, min_letters: int) -> DataFrame:
    """(id, line_no, site, h1, h2) of every line long enough on a known site, once per document."""
    lines = F.split(F.col(text_col), "\n", -1)
    return (
        docs.select(F.col(id_col).alias("_id"), site_of(F.col(url_col)).alias("_site"), F.posexplode(lines).alias("_n", "_line"))
        .filter(F.col("_site").isNotNull() & F.col("_id").isNotNull() & (F.length("_line") >= min_letters))
        .select("_id", "_site", (F.col("_n") + 1).alias("_no"), line_key(F.col("_line")).alias("_key"))
        .filter(F.length("_key") >= min_letters)
        .select("_id", "_no", F.xxhash64("_site", "_key").alias("_h1"), F.hash("_key").alias("_h2"), "_site")
    )


def repeated_lines(
    docs: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", url_col: str = "url", min_letters: int = 12,
    min_docs: int = 12, min_share: float = 0.0,
) -> DataFrame:
    """(id, line_no): the lines found in at least ``min_docs`` documents of their site, and that share of them."""
    # counted and looked up again: written once, without the texts
    lines = cut(document_lines(docs, id_col, text_col, url_col, min_letters))
    keys = ["_h1", "_h2"]
    held = lines.select("_id", *keys, "_site").distinct() if min_share > 0 else lines.select("_id", *keys).distinct()
    frequent = held.groupBy(*keys, *(["_site"] if min_share > 0 else [])).agg(F.count("*").alias("_docs")).filter(F.col("_docs") >= min_docs)
    if min_share > 0:
        sizes = (
            docs.select(F.col(id_col).alias("_id"), site_of(F.col(url_col)).alias("_site")).filter(F.col("_site").isNotNull())
            .distinct().groupBy("_site").agg(F.count("*").alias("_all"))
        )
        frequent = frequent.join(sizes, "_site").filter(F.col("_docs") >= min_share * F.col("_all"))
    frequent = over_salts(frequent.select(*keys), SALTS)
    hits = with_salt(lines.select("_id", "_no", *keys), "_id", SALTS).join(frequent, [*keys, "_salt"], "left_semi")
    return hits.select(F.col("_id").alias(id_col), F.col("_no").alias("line_no")).distinct()


def without_repeated_lines(
    docs: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", url_col: str = "url", **limits
) -> DataFrame:
    """``docs`` with ``clean_text`` (the text without its site's repeated lines) and ``lines_removed``.

    Every row is kept, null texts stay null, and a text made of site matter only becomes empty.
    """
    hits = (
        repeated_lines(docs, id_col=id_col, text_col=text_col, url_col=url_col, **limits)
        .groupBy(F.col(id_col).alias("__hit_id")).agg(F.collect_set("line_no").alias("__drop"))
    )
    joined = docs.join(hits, docs[id_col] == hits["__hit_id"], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__drop"), (i + 1).cast("int"))), "\n")
    clean = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(kept)
    return joined.withColumn("clean_text", clean).withColumn("lines_removed", F.coalesce(F.size("__drop"), F.lit(0))).drop("__drop", "__hit_id")
