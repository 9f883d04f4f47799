"""From marked-up or positioned source text to chunks, as windows over rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions.text import has_real_word, is_furniture, slug

FIRST_HEADING = "Introduction"
EMPTY_PAGE_SIZE = 10.0


def level_paths(rows: DataFrame, *, levels: int = 6, doc: str = "doc", seq: str = "seq") -> DataFrame:
    """Paths of a flat sequence of labelled paragraphs (doc, seq, level, label, text).

    A label at level N replaces the one before it there and ends all deeper ones; levels may be
    skipped. A row without a label counts as ``?``. Rows with blank text come out no more, but
    their labels count. Levels outside 1..``levels`` raise. ``path`` is an array of (level, label).
    """
    w = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    label = F.coalesce("label", F.lit("?"))
    bad = (F.col("level") < 1) | (F.col("level") > levels)
    out = rows.withColumn("level", F.when(bad, F.raise_error(F.lit("level out of range"))).otherwise(F.col("level")))
    for n in range(1, levels + 1):
        # the last label set at this level, unless a shallower row came after it
        set_at = F.max(F.when(F.col("level") == n, F.col(seq))).over(w)
        shut_at = F.max(F.when(F.col("level") < n, F.col(seq))).over(w)
        text = F.last(F.when(F.col("level") == n, label), ignorenulls=True).over(w)
        live = set_at.isNotNull() & (shut_at.isNull() | (shut_at < set_at))
        out = out.withColumn(f"_l{n}", F.when(live, F.struct(F.lit(str(n)).alias("role"), text.alias("label"))))
    path = F.filter(F.array(*(f"_l{n}" for n in range(1, levels + 1))), lambda x: x.isNotNull())
    out = out.withColumn("path", path).drop(*(f"_l{n}" for n in range(1, levels + 1)))
    return out.filter(F.length(F.trim("text")) > 0)


def body_sizes(words: DataFrame) -> DataFrame:
    """(doc, page, body_size): the most common size, to one digit, of each page; ties go to the one seen first."""
    sizes = words.withColumn("_s", F.round("size", 1)).groupBy("doc", "page", "_s").agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    return sizes.groupBy("doc", "page").agg(F.min_by("_s", F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"))).alias("body_size"))


def lines(words: DataFrame) -> DataFrame:
    """(doc, page, line_top, text, n_words, avg_size, bold): words of one rounded height, from left to right."""
    bold = F.col("fontname").contains("Bold") | F.col("fontname").contains("-Bd")
    grouped = words.groupBy("doc", "page", F.bround("top", 0).alias("line_top")).agg(
        F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))).alias("_w"), F.count("*").alias("n_words"),
        F.avg("size").alias("avg_size"), F.avg(bold.cast("double")).alias("bold"),
    )
    return grouped.select("doc", "page", "line_top", F.array_join(F.col("_w.text"), " ").alias("text"), "n_words", "avg_size", "bold")


def is_heading(text: Column, n_words: Column, avg_size: Column, bold: Column, body_size: Column) -> Column:
    """Up to 12 words with a real one among them, larger than the body by more than 1 or 60 % bold."""
    return (n_words <= 12) & has_real_word(text) & ((avg_size > body_size + 1.0) | (bold >= 0.6))


def heading_sections(flagged: DataFrame, order: list[str]) -> DataFrame:
    """(doc, section_no, heading, text) from lines (doc, ``order``, text, heading flag ``is_heading``).

    Text gathers below the last heading, across pages; what comes first is the introduction. A
    heading without text is left out. Blank lines and page furniture count for nothing.
    """
    kept = flagged.withColumn("text", F.trim("text")).filter((F.col("text") != "") & ~is_furniture(F.col("text")))
    w = Window.partitionBy("doc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = kept.withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(w))
    key = F.struct(*order, F.when(~F.col("is_heading"), F.col("text")).alias("t"))
    parts = islands.groupBy("doc", "section_no").agg(F.max(F.when(F.col("is_heading"), F.col("text"))).alias("heading"), F.array_sort(F.collect_list(key)).alias("_p"))
    text = F.array_join(F.filter(F.col("_p.t"), lambda t: t.isNotNull()), " ")
    out = parts.select("doc", "section_no", F.coalesce("heading", F.lit(FIRST_HEADING)).alias("heading"), text.alias("text"))
    return out.filter(F.length(F.trim("text")) > 0)


def pdf_sections(words: DataFrame) -> DataFrame:
    """Sections of positioned words by their headings; pages without words have the default body size."""
    sized = lines(words).join(body_sizes(words), ["doc", "page"], "left").withColumn("body_size", F.coalesce("body_size", F.lit(EMPTY_PAGE_SIZE)))
    text = F.trim("text")
    flagged = sized.withColumn("is_heading", is_heading(text, F.col("n_words"), F.col("avg_size"), F.col("bold"), F.col("body_size")))
    return heading_sections(flagged, ["page", "line_top"])


def occurrence_ids(rows: DataFrame, citation: Column, *, doc: str = "doc", seq: str = "seq") -> DataFrame:
    """``chunk_id`` from the slug of the citation; the n-th of one slug in a document ends in ``-n``."""
    out = rows.withColumn("_slug", slug(citation))
    nth = F.row_number().over(Window.partitionBy(doc, "_slug").orderBy(seq))
    return out.withColumn("_nth", nth).withColumn("chunk_id", F.when(F.col("_nth") == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", F.col("_nth").cast("string")))).drop("_slug", "_nth")


def build_chunks(sections: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks in corpus order from sections (filename, doc_pos, seq, path array of (role, label), text)."""
    meta = registry.select("filename", "citation_prefix", "source_type", "authority_weight", "tax_year_start", "tax_year_end", "url")
    rows = sections.join(F.broadcast(meta), "filename")
    by_heading = (F.size("path") == 1) & (F.try_element_at("path", F.lit(1))["role"] == "heading")
    heading = F.try_element_at("path", F.lit(1))["label"]
    marks = F.transform("path", lambda p: F.concat(F.lit("("), p["label"], F.lit(")")))
    prefix = F.col("citation_prefix")
    citation = F.when(by_heading, F.concat(prefix, F.lit(" — "), heading)).otherwise(F.concat(prefix, F.array_join(marks, "")))
    header = F.when(by_heading, F.concat(prefix, F.lit(" > "), heading)).otherwise(F.concat_ws(" > ", prefix, marks))
    rows = rows.withColumn("citation", citation).withColumn("text", F.concat(header, F.lit(" — "), F.col("text")))
    rows = occurrence_ids(rows, F.col("citation"), doc="filename", seq="seq")
    # corpus order without sorting it all in one task: documents are few, their offsets small
    counts = rows.groupBy("filename", "doc_pos").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("doc_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("filename", "_o")
    place = F.row_number().over(Window.partitionBy("filename").orderBy("seq")) - 1
    out = rows.withColumn("_p", place).join(F.broadcast(before), "filename").withColumn("pos", (F.col("_p") + F.col("_o")).cast("long"))
    return out.select("chunk_id", "text", "citation", "source_type", "authority_weight", "tax_year_start", "tax_year_end", "url", "pos")


def parse_corpus(statutes: DataFrame, regulations: DataFrame, others: DataFrame, registry: DataFrame) -> DataFrame:
    """All parsers' sections, each (filename, seq, path, text), in registry order as chunks."""
    every = reduce(DataFrame.unionByName, (x.select("filename", "seq", "path", "text") for x in (statutes, regulations, others)))
    return build_chunks(every.join(F.broadcast(registry.select("filename", "doc_pos")), "filename"), registry)
