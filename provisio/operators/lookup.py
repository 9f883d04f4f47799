"""Exact lookup of cited provisions and what lies closest below them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions.citations import path, provision_id, section
from provisio.runtime import cut


def parsed(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with section, path and pid (provision id) of the first statute citation in a text; nulls where none."""
    out = df.withColumns({"section": section(F.col(text_col)), "path": path(F.col(text_col))})
    return out.withColumn("pid", provision_id(F.col("section"), F.col("path")))


def provisions(chunks: DataFrame) -> DataFrame:
    """(pid, section, path, chunk_id, first_pos): one row for each provision that has a chunk.

    Of several chunks of one provision the last one is taken, at the place of the first.
    """
    rows = parsed(chunks.select("chunk_id", "citation", "pos"), "citation").filter("pid is not null")
    return rows.groupBy("pid", "section", "path").agg(F.max_by("chunk_id", "pos").alias("chunk_id"), F.min("pos").alias("first_pos"))


def descendants(targets: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, pid, chunk_id, depth, first_pos): the closest provisions below each query's pid, on every branch.

    ``a`` is below ``b`` if b's path starts a's, so each provision is exploded into the pids of
    its proper ancestors and matched by equality. A match with another match above it is dropped.
    """
    above = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: provision_id(F.col("section"), F.slice("path", F.lit(1), n)))
    below = known.filter(F.size("path") > 0).select("pid", "chunk_id", "first_pos", F.size("path").alias("depth"), F.explode(above).alias("target"))
    hits = targets.select("query_id", F.col("pid").alias("target")).join(below, "target")
    ups = known.filter(F.size("path") > 0).select("pid", F.explode(above).alias("up"))
    covered = hits.select("query_id", "pid").join(ups, "pid").join(hits.select("query_id", F.col("pid").alias("up")), ["query_id", "up"], "left_semi")
    return hits.join(covered.select("query_id", "pid").distinct(), ["query_id", "pid"], "left_anti").select("query_id", "pid", "chunk_id", "depth", "first_pos")


def lookup(questions: DataFrame, chunks: DataFrame, *, text_col: str = "question") -> DataFrame:
    """(query_id, chunk_id, ord) of the provisions that a question's first citation names.

    With anything below it: its own chunk, if any, then the closest below, by depth and place. A
    leaf: its own chunk, then its parent's, if any. Nothing found: no row.
    """
    targets = parsed(questions.select("query_id", F.col(text_col).alias("_q")), "_q").filter("pid is not null").select("query_id", "section", "path", "pid")
    # both are used several times below: the table of provisions, and what a bounded number of questions meet in it
    known = cut(provisions(chunks))
    own = targets.join(known.select("pid", "chunk_id"), "pid").select("query_id", "chunk_id", "section", "path")
    low = cut(descendants(targets, known))
    down = low.select("query_id", "chunk_id", F.lit(1).alias("_b"), F.col("depth").alias("_d"), F.col("first_pos").alias("_p"))
    leaves = own.join(low.select("query_id").distinct(), "query_id", "left_anti").filter(F.size("path") > 0)
    up = leaves.withColumn("pid", provision_id(F.col("section"), F.slice("path", F.lit(1), F.size("path") - 1)))
    up = up.drop("chunk_id").join(known.select("pid", "chunk_id"), "pid").select("query_id", "chunk_id", F.lit(2).alias("_b"), F.lit(0).alias("_d"), F.lit(0).cast("long").alias("_p"))
    self_rows = own.select("query_id", "chunk_id", F.lit(0).alias("_b"), F.lit(0).alias("_d"), F.lit(0).cast("long").alias("_p"))
    order = Window.partitionBy("query_id").orderBy("_b", "_d", "_p", "chunk_id")
    rows = self_rows.unionByName(down).unionByName(up)
    return rows.withColumn("ord", F.row_number().over(order)).select("query_id", "chunk_id", "ord")
