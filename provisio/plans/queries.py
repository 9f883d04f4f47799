"""Registered queries of the retrieval engine, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provisio.functions import citations as cite
from provisio.functions.text import tokens
from provisio.operators import answer, bm25, dense, fusion, html, ingest, lookup, metrics, runs
from provisio.operators.embed import HashingEmbedder, embedded
from provisio.plans.evaluate import score_items
from provisio.plans.pipeline import ABLATION, PipelineConfig, retrieve
from provisio.runtime import cut, ensure_checkpoint_dir
from provisio.sources.corpus import corpus, latest, read_vectors, registered, upsert_vectors
from provisio.sources.tables import table
from provisio.streaming.questions import serve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIM = 64


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def golden(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden_set")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return golden(spark, d).select(F.col("id").alias("query_id"), "question", "tax_year")


def cited_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that name their provisions."""
    return golden(spark, d).select(F.col("id").alias("query_id"), F.concat_ws(" ", "question", "draft_citation").alias("question"), "tax_year")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "eval_results"), ["run_id", "id"], "scored_at")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", digits))


def fused(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieved")
    return fusion.reciprocal_rank_fusion([rows.filter(F.col("retriever") == x) for x in ("dense", "sparse")])


def retrieved_by(spark: SparkSession, d: str, configs: dict[str, PipelineConfig]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(lists by configuration, chunks) for the questions that name their provisions; corpus, vectors and index are made once.

    Hashed words stand in for a model's vectors.
    """
    embedder = HashingEmbedder(DIM)
    chunks = cut(corpus(spark, d))
    asked = cited_questions(spark, d)
    vectors = cut(embedded(chunks.select("chunk_id", "text"), embedder).select("chunk_id", "embedding")) if any(c.use_dense for c in configs.values()) else None
    index = bm25.build(chunks) if any(c.use_sparse for c in configs.values()) else None
    return {n: retrieve(asked, chunks, c, vectors=vectors, embedder=embedder, index=index) for n, c in configs.items()}, chunks


def hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lists, chunks = retrieved_by(spark, d, {"hybrid": ABLATION["hybrid"]})
    return lists["hybrid"], chunks


# --- scans and sinks


@query
def registry_join(spark: SparkSession, d: str) -> DataFrame:
    """Registered files with their metadata; an unregistered one fails the query."""
    reg = table(spark, d, "registry")
    files = reg.select("filename")
    return registered(files, reg).select("filename", "citation_prefix", "source_type", "authority_weight", "url")


@query
def chunks_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Chunks stamped with their document: how many, and their summed weight."""
    prefix = F.regexp_replace(F.col("citation"), r"( —|\().*$", "")
    rows = corpus(spark, d).select(prefix.alias("citation_prefix"))
    meta = table(spark, d, "registry").select("filename", "citation_prefix", "authority_weight")
    out = rows.join(F.broadcast(meta), "citation_prefix").groupBy("filename").agg(F.count("*").alias("n_chunks"), F.round(F.sum("authority_weight"), 4).alias("weight"))
    return out


@query
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("chunk_id", "citation", "pos", F.length("text").cast("long").alias("n_chars"))


@query
def golden_head(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 questions, the evaluation's head option."""
    return golden(spark, d).orderBy("id").limit(25).select("id", "category", "question")


@query
def upserted_vectors(spark: SparkSession, d: str) -> DataFrame:
    return runs.upserted(table(spark, d, "chunk_vectors")).select("chunk_id", "embedded_at", F.size("embedding").cast("long").alias("width"))


@query
def embedding_drift_check(spark: SparkSession, d: str) -> DataFrame:
    return runs.drift(table(spark, d, "chunks"), table(spark, d, "chunk_vectors"))


@query
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.latest_runs(table(spark, d, "eval_results"))


@query
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_results")
    return runs.remaining(golden(spark, d), rows, runs.latest_runs(rows))


# --- parsing and chunk building


def leveled(spark: SparkSession, d: str) -> DataFrame:
    """Statute and regulation chunks as flat labelled paragraphs."""
    rows = corpus(spark, d).filter(F.lower(F.trim("source_type")).isin("statute", "regulation"))
    labels = F.regexp_extract_all("citation", F.lit(r"\(([A-Za-z0-9]+)\)"), F.lit(1))
    return rows.select(
        F.regexp_replace("citation", r"\(.*$", "").alias("doc"), F.col("pos").alias("seq"), F.greatest(F.size(labels), F.lit(1)).alias("level"),
        F.try_element_at(labels, F.lit(-1)).alias("label"), F.coalesce("text", F.lit("")).alias("text"),
    )


@query
def flat_level_paths(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.level_paths(leveled(spark, d))
    return out.select("doc", "seq", F.array_join(F.transform("path", lambda p: F.concat(p["role"], F.lit(":"), p["label"])), "/").alias("path"))


@query
def slug_and_dedupe_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).select(F.regexp_replace("citation", r"( —|\().*$", "").alias("doc"), F.col("pos").alias("seq"), "citation")
    return ingest.occurrence_ids(rows, F.col("citation")).select("seq", "chunk_id")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents", spread=True).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


@query
def heading_segments(spark: SparkSession, d: str) -> DataFrame:
    """Short lines without a closing mark taken as headings."""
    rows = document_lines(spark, d)
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^ \t]+)"), F.lit(1)))
    flag = (words <= 12) & F.col("text").rlike("[A-Za-z]{3,}") & ~F.rtrim("text").rlike("[.;:,!?]$")
    out = ingest.heading_sections(rows.withColumn("is_heading", flag), ["line_no"])
    return out.select(F.col("doc").alias("doc_id"), "section_no", "heading", "text")


@query
def pdf_sections(spark: SparkSession, d: str) -> DataFrame:
    """Positioned words: 40 lines to a page, lines in capitals set larger, every eleventh line bold."""
    rows = document_lines(spark, d).select("doc", "line_no", (F.upper("text") == F.col("text")).alias("caps"), F.regexp_extract_all("text", F.lit(r"([^ \t\r]+)"), F.lit(1)).alias("ws"))
    rows = rows.select("doc", "line_no", "caps", F.posexplode("ws").alias("at", "word"))
    words = rows.select(
        F.col("doc").cast("string").alias("doc"), F.floor(F.col("line_no") / 40).cast("int").alias("page"), (F.col("line_no") * 10000 + F.col("at")).alias("seq"), F.col("word").alias("text"),
        F.when(F.col("caps"), 14.0).otherwise(10.0).alias("size"), F.when(F.col("line_no") % 11 == 0, "Serif-Bold").otherwise("Serif").alias("fontname"), F.col("at").cast("double").alias("x0"), (F.col("line_no") + 0.25).alias("top"),
    )
    return ingest.pdf_sections(words).select("doc", "section_no", "heading", "text")


@query
def modal_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as words: an order is a page, quantities are sizes."""
    words = table(spark, d, "lineitem").select(F.lit("all").alias("doc"), F.col("l_orderkey").alias("page"), F.struct("l_partkey", "l_quantity").alias("seq"), F.col("l_quantity").alias("size"))
    return ingest.body_sizes(words).select(F.col("page").alias("l_orderkey"), "body_size")


@query
def word_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as words: heights are prices, rounded half to even."""
    words = table(spark, d, "lineitem").select(
        F.lit("all").alias("doc"), F.col("l_orderkey").alias("page"), F.struct("l_partkey", "l_quantity").alias("seq"), F.col("l_partkey").cast("string").alias("text"),
        F.col("l_quantity").alias("size"), F.lit("Serif-Bd").alias("fontname"), F.col("l_discount").alias("x0"), (F.col("l_extendedprice") / 10000).alias("top"),
    )
    return ingest.lines(words).select(F.col("page").alias("l_orderkey"), F.col("line_top").cast("long").alias("line_top"), "text", "n_words", F.round("avg_size", 6).alias("avg_size"), "bold")


@query
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as nested statute pages, parsed back; notes are skipped."""
    plain = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    labels = F.regexp_extract_all("citation", F.lit(r"\(([A-Za-z0-9]+)\)"), F.lit(1))
    opens = F.array_join(F.transform(labels, lambda x: F.concat(F.lit('<div class="subsection x"><span class="num" value="'), x, F.lit('"></span>'))), "")
    page = F.concat(F.lit('<div class="section">'), opens, F.lit('<div class="content">'), plain, F.lit('</div><div class="note">left out</div>'), F.repeat(F.lit("</div>"), F.size(labels) + 1))
    rows = corpus(spark, d).filter("text is not null").select(F.col("chunk_id").alias("filename"), page.alias("html"))
    out = html.parse_statutes(rows)
    return out.select(F.col("filename").alias("chunk_id"), F.array_join(F.col("path.label"), "/").alias("path"), "text")


@query
def html_paragraph_paths(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as flat regulation paragraphs, one page for each document, parsed back to paths."""
    body = F.replace(F.replace(F.replace(F.regexp_replace(F.col("text"), r"\s+", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit('<span class="enumxml">('), F.col("label"), F.lit(")</span>")))
    para = F.concat(F.lit('<p class="psection-'), F.col("level").cast("string"), F.lit('">'), mark, F.lit(" "), body, F.lit("</p>"))
    pages = leveled(spark, d).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", para.alias("p")))).alias("ps"))
    parsed = html.parse_regulations(pages.select(F.col("doc").alias("filename"), F.array_join(F.col("ps.p"), "\n").alias("html")))
    out = ingest.level_paths(parsed, doc="filename")
    return out.select("filename", F.col("seq").cast("long").alias("seq"), F.array_join(F.transform("path", lambda p: F.concat(p["role"], F.lit(":"), p["label"])), "/").alias("path"))


@query
def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    """All three parsers end to end: nested statute pages, flat regulation pages and headed sections become one corpus in registry order."""
    reg = table(spark, d, "registry").withColumn("doc_pos", F.row_number().over(Window.orderBy("filename")))
    rows = corpus(spark, d).filter("length(trim(text)) > 0").withColumn("citation_prefix", F.regexp_replace("citation", r"( —|\().*$", ""))
    rows = rows.join(F.broadcast(reg.select("citation_prefix", "filename")), "citation_prefix")
    rows = rows.withColumns({"kind": F.lower(F.trim("source_type")), "labels": F.regexp_extract_all("citation", F.lit(r"\(([A-Za-z0-9]+)\)"), F.lit(1)), "body": F.regexp_replace("text", r"\s+", " ")})
    plain = F.replace(F.replace(F.replace(F.col("body"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    # a statute page holds each chunk in divisions of its own
    opens = F.array_join(F.transform("labels", lambda x: F.concat(F.lit('<div class="subsection"><span class="num" value="'), x, F.lit('"></span>'))), "")
    division = F.concat(opens, F.lit('<div class="content">'), plain, F.lit("</div>"), F.repeat(F.lit("</div>"), F.size("labels")))
    pages = lambda kind, part: rows.filter(F.col("kind") == kind).groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))).alias("ps"))
    statutes = html.parse_statutes(pages("statute", division).select("filename", F.concat(F.lit('<div class="section">'), F.array_join(F.col("ps.p"), ""), F.lit("</div>")).alias("html")))
    label = F.try_element_at("labels", F.lit(-1))
    para = F.concat(F.lit('<p class="psection-'), F.greatest(F.size("labels"), F.lit(1)).cast("string"), F.lit('">'), F.when(label.isNotNull(), F.concat(F.lit('<span class="enumxml">('), label, F.lit(")</span>"))).otherwise(F.lit("")), F.lit(" "), plain, F.lit("</p>"))
    regulations = ingest.level_paths(html.parse_regulations(pages("regulation", para).select("filename", F.array_join(F.col("ps.p"), "\n").alias("html"))), doc="filename")
    others = rows.filter(~F.col("kind").isin("statute", "regulation")).select(
        "filename", F.col("pos").alias("seq"), F.array(F.struct(F.lit("heading").alias("role"), F.coalesce(F.nullif(F.regexp_extract("citation", " — (.*)$", 1), F.lit("")), F.lit(ingest.FIRST_HEADING)).alias("label"))).alias("path"), F.trim("body").alias("text"),
    )
    out = ingest.parse_corpus(statutes, regulations, others, reg)
    return out.select("chunk_id", "citation", "text", "source_type", "authority_weight", "url", "pos")


# --- retrieval


@query
def tokenize_stopwords(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("chunk_id", F.size(tokens(F.col("text"))).cast("long").alias("dl"), F.array_join(tokens(F.col("citation")), " ").alias("words"))


@query
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.build(corpus(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def term_postings(spark: SparkSession, d: str) -> DataFrame:
    return bm25.postings(bm25.build(corpus(spark, d))).withColumn("dl", F.col("dl").cast("long"))


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bm25.top_k(bm25.build(corpus(spark, d)), questions(spark, d), 20))


@query
def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    rows = table(spark, d, "embeddings")
    asked = rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(dense.top_k(rows, asked, 20, dim=DIM, id_col="vec_id", vec_col="embedding"), 5)


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fused(spark, d), 9)


@query
def authority_reorder(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.by_authority(fused(spark, d), corpus(spark, d)), 9)


@query
def tax_year_filter(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "retrieved").groupBy("query_id").agg((F.year(F.min("asked_at")) - 3).alias("tax_year"))
    return rounded(fusion.in_force(fused(spark, d), corpus(spark, d), years), 9)


@query
def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).select(F.col("chunk_id").alias("id"), "citation").unionByName(golden(spark, d).select("id", F.col("draft_citation").alias("citation")))
    return lookup.parsed(rows, "citation").select("id", "section", F.array_join("path", "/").alias("path"), "pid")


@query
def provision_map(spark: SparkSession, d: str) -> DataFrame:
    return lookup.provisions(corpus(spark, d)).select("pid", "chunk_id", "first_pos")


@query
def citation_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The closest provisions below every cited one, and below the section it stands in."""
    asked = lookup.parsed(cited_questions(spark, d), "question").filter("pid is not null")
    whole = asked.select(F.concat("query_id", F.lit("/section")).alias("query_id"), cite.provision_id(F.col("section"), F.array().cast("array<string>")).alias("pid"))
    out = lookup.descendants(asked.select("query_id", "pid").unionByName(whole), lookup.provisions(corpus(spark, d)))
    return out.select("query_id", "pid", "chunk_id", F.col("depth").cast("long").alias("depth"))


@query
def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.lookup(cited_questions(spark, d), corpus(spark, d))


@query
def hybrid_with_citation(spark: SparkSession, d: str) -> DataFrame:
    """Dense and sparse lists of ``k_retrieve`` fused, looked-up provisions first, cut at ``k_final``."""
    return rounded(hybrid(spark, d)[0])


@query
def sparse_with_citation(spark: SparkSession, d: str) -> DataFrame:
    """Sparse retrieval with looked-up provisions first."""
    return rounded(retrieved_by(spark, d, {"sparse": ABLATION["bm25_only"]})[0]["sparse"])


@query
def hybrid_in_force(spark: SparkSession, d: str) -> DataFrame:
    """Fused lists without looked-up provisions, only chunks in force in a question's year, heavier authorities first among equals."""
    config = PipelineConfig(use_sparse=True, use_citation_lookup=False, order_by_authority=True, filter_tax_year=True)
    return rounded(retrieved_by(spark, d, {"own": config})[0]["own"])


@query
def ablation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every configuration over all questions."""
    out = None
    for name, rows in retrieved_by(spark, d, ABLATION)[0].items():
        rows = rows.withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)


def spelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("embedding", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ","))


@query
def embed_hash_udf(spark: SparkSession, d: str) -> DataFrame:
    return spelled(embedded(corpus(spark, d).select("chunk_id", "text"), HashingEmbedder(DIM)).select("chunk_id", "embedding"))


@query
def embed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the instruction before them."""
    return spelled(embedded(questions(spark, d), HashingEmbedder(DIM), text_col="question", is_query=True).select("query_id", "embedding"))


@query
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written in two loads, the second over the first, and read back."""
    import uuid

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/vectors-{uuid.uuid4().hex}"
    rows = table(spark, d, "chunk_vectors").withColumn("width", F.size("embedding")).drop("embedding")
    late = F.xxhash64("chunk_id", "embedded_at") % 2 == 0
    upsert_vectors(rows.filter(late), path)
    upsert_vectors(rows.filter(~late), path)
    return read_vectors(spark, path).select("chunk_id", "embedded_at", F.col("width").cast("long").alias("width"))


@query
def stream_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Questions read as a stream, looked up batch by batch, appended and read back."""
    import uuid

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    chunks = cut(corpus(spark, d).select("chunk_id", "citation", "pos"))
    arriving = spark.readStream.schema(golden(spark, d).schema).parquet(f"{d}/golden_se[t].parquet")  # a pattern, as the source takes no single file
    arriving = arriving.select(F.col("id").alias("query_id"), F.concat_ws(" ", "question", "draft_citation").alias("question"))
    serve(arriving, lambda batch: lookup.lookup(batch, chunks), f"{base}/out", f"{base}/state", once=True).awaitTermination()
    return spark.read.schema("query_id string, chunk_id string, ord int").parquet(f"{base}/out").select("query_id", "chunk_id", "ord")


# --- answers


def spoken(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(answers, retrieved): each query's first chunk as its answer, and the citations of all its chunks."""
    rows = table(spark, d, "retrieved")
    chunks = corpus(spark, d)
    held = rows.select("query_id", "chunk_id").distinct().join(chunks.select("chunk_id", "citation"), "chunk_id")
    first = rows.filter("rank = 1").groupBy("query_id").agg(F.min("chunk_id").alias("chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
    return first.select("query_id", "text"), held.select("query_id", "citation")


def all_lists_fused(spark: SparkSession, d: str) -> DataFrame:
    """The ``k_final`` best of each query over the lists of all retrievers, among chunks still in the corpus.

    A row without a rank takes the place that its score has in its list, without a usable score the last.
    """
    rows = table(spark, d, "retrieved").join(corpus(spark, d).select("chunk_id"), "chunk_id", "left_semi")
    score = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    rows = rows.groupBy("query_id", "chunk_id", "retriever").agg(F.min("rank").alias("rank"), F.max(score).alias("_s"))
    by_score = Window.partitionBy("query_id", "retriever").orderBy(F.desc_nulls_last("_s"), "chunk_id")
    rows = rows.withColumn("rank", F.coalesce("rank", F.row_number().over(by_score)))
    return fusion.reciprocal_rank_fusion([rows.filter(F.col("retriever") == x) for x in ("dense", "sparse", "dense+sparse")], k=PipelineConfig().k_final)


@query
def context_build(spark: SparkSession, d: str) -> DataFrame:
    return answer.contexts(all_lists_fused(spark, d), corpus(spark, d))


@query
def prompts(spark: SparkSession, d: str) -> DataFrame:
    out = context_build(spark, d).withColumn("prompt", answer.prompt(F.col("context"), F.concat(F.lit("question "), F.col("query_id"))))
    return out.select("query_id", "prompt", answer.is_refusal(F.col("context")).alias("refused"))


@query
def mention_extraction(spark: SparkSession, d: str) -> DataFrame:
    return answer.grounded_mentions(*spoken(spark, d)).select("query_id", "mention", F.col("ord").cast("long").alias("ord"))


@query
def grounded_citations(spark: SparkSession, d: str) -> DataFrame:
    return answer.grounded_citations(*spoken(spark, d))


@query
def hallucinated_citations(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hallucinated(*spoken(spark, d))


@query
def extractive_answers(spark: SparkSession, d: str) -> DataFrame:
    ranked, chunks = hybrid(spark, d)
    out = answer.answers(questions(spark, d), cut(ranked), chunks, answer.ExtractiveGenerator())
    return out.select("query_id", "text", "citations", "refused", "refusal_reason", "trace.model", "trace.cost_usd")


# --- evaluation


@query
def required_keys(spark: SparkSession, d: str) -> DataFrame:
    return metrics.required_citations(golden(spark, d)).withColumn("n", F.col("n").cast("long"))


@query
def citation_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("citation")
    return corpus(spark, d).select("chunk_id", cite.citation_key(c).alias("citation_key"), cite.mention_key(c).alias("mention_key"))


def recall_rows(spark: SparkSession, d: str) -> DataFrame:
    ranked, chunks = hybrid(spark, d)
    return metrics.retrieval_scores(golden(spark, d), ranked, chunks)


@query
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return recall_rows(spark, d).select("id", "category", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query
def recall_mrr_by_category(spark: SparkSession, d: str) -> DataFrame:
    rows = recall_rows(spark, d)
    out = rows.rollup("category").agg(F.count("*").alias("questions"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"))
    return out.withColumn("category", F.coalesce("category", F.lit("all")))


@query
def citation_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Citations of all runs' answers taken together, for each item."""
    rows = scored(spark, d).select(F.col("id").alias("query_id"), F.explode("hallucinated_citations").alias("c")).distinct()
    said = rows.groupBy("query_id").agg(F.collect_set("c").alias("citations"))
    return metrics.citation_accuracy(golden(spark, d), said).withColumn("citation_accuracy", F.round("citation_accuracy", 6))


@query
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_summaries(scored(spark, d))


@query
def eval_by_category(spark: SparkSession, d: str) -> DataFrame:
    return metrics.category_breakdown(scored(spark, d))


@query
def judge_json_parse(spark: SparkSession, d: str) -> DataFrame:
    """What judges left as it is, and the same scores written as the JSON they were asked for."""
    rows = scored(spark, d)
    good = F.to_json(F.struct("groundedness", "premise_correction", F.col("judge_reasoning").alias("reasoning")))
    both = rows.select("run_id", "id", F.lit("left").alias("form"), F.col("judge_reasoning").alias("raw")).unionByName(rows.select("run_id", "id", F.lit("json").alias("form"), good.alias("raw")))
    out = both.filter("raw is not null").withColumn("j", metrics.parse_judgement(F.col("raw")))
    return out.select("run_id", "id", "form", F.col("j.groundedness"), F.col("j.premise_correction"), F.col("j.reasoning"))


@query
def full_run(spark: SparkSession, d: str) -> DataFrame:
    """Retrieve once, answer, judge and score every question, with the offline stand-ins; times are left out."""
    ranked, chunks = hybrid(spark, d)
    out = score_items(golden(spark, d), cut(ranked), chunks, generator=answer.ExtractiveGenerator(), judge=metrics.OverlapJudge())
    return out.drop("latency_s").withColumns({c: F.round(c, 6) for c in ("recall_at_5", "mrr", "citation_accuracy")}).withColumn("hallucinated_citations", F.array_sort("hallucinated_citations"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval: sparse and dense lists fused, cited provisions first."""
    return hybrid_with_citation(spark, d)
