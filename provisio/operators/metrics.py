"""Scores of retrieval runs and answers against the golden set."""

from __future__ import annotations

import json
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions.citations import citation_key, cited_tokens, prefixes, required
from provisio.runtime import cut

JUDGEMENT = "groundedness int, premise_correction int, reasoning string"


def required_citations(golden: DataFrame) -> DataFrame:
    """(query_id, category, n, req_key): one row for each required citation; out-of-scope items require none."""
    field = F.when(F.col("category") == "out_of_scope", F.lit("")).otherwise(F.col("draft_citation"))
    parts = golden.select(F.col("id").alias("query_id"), "category", F.posexplode(required(field)).alias("n", "req"))
    return parts.select("query_id", "category", "n", citation_key(F.col("req")).alias("req_key"))


def matches(req: DataFrame, cited: DataFrame) -> DataFrame:
    """Rows of (query_id, n, ...) x (query_id, key, ...) where either key begins the other, by equality on prefixes."""
    # written once: used twice, and a whole retrieval plan joined with itself isn't planned reliably
    req, cited = req.withColumnRenamed("query_id", "_q"), cut(cited.withColumnRenamed("query_id", "_cq"))
    r_up = req.withColumn("_p", F.explode(prefixes(F.col("req_key"))))
    up = r_up.join(cited, (F.col("_q") == F.col("_cq")) & (F.col("_p") == F.col("key")))
    c_up = cited.withColumn("_p", F.explode(prefixes(F.col("key"))))
    down = req.join(c_up, (F.col("_q") == F.col("_cq")) & (F.col("_p") == F.col("req_key")))
    return up.drop("_p", "_cq").unionByName(down.drop("_p", "_cq")).withColumnRenamed("_q", "query_id").distinct()


def retrieval_scores(golden: DataFrame, ranked: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(id, category, recall, mrr) of each item over its ``k`` first rows.

    recall: share of the required citations matched; mrr: 1 / the stored rank of the first match,
    0 without one. Both are null where nothing is required.
    """
    req = required_citations(golden)
    cited = ranked.filter(F.col("rank") <= k).join(chunks.select("chunk_id", "citation"), "chunk_id")
    cited = cited.select("query_id", citation_key(F.col("citation")).alias("key"), "rank").filter("key is not null")
    hits = matches(req.select("query_id", "n", "req_key"), cited).groupBy("query_id").agg(F.countDistinct("n").alias("_h"), F.min("rank").alias("_r"))
    need = req.groupBy("query_id").agg(F.count("*").alias("_all"))
    out = golden.select(F.col("id").alias("query_id"), "category").join(need, "query_id", "left").join(hits, "query_id", "left")
    some = F.col("_all").isNotNull()
    return out.select(
        F.col("query_id").alias("id"), "category",
        F.when(some, F.coalesce("_h", F.lit(0)) / F.col("_all")).alias("recall"),
        F.when(some, F.coalesce(F.lit(1.0) / F.col("_r"), F.lit(0.0))).alias("mrr"),
    )


def citation_accuracy(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, citation_accuracy): share of the required citations among those an answer (query_id, citations) used."""
    req = required_citations(golden)
    cited = answers.select("query_id", F.explode("citations").alias("c")).select("query_id", citation_key(F.col("c")).alias("key"))
    hits = matches(req.select("query_id", "n", "req_key"), cited).groupBy("query_id").agg(F.countDistinct("n").alias("_h"))
    need = req.groupBy("query_id").agg(F.count("*").alias("_all"))
    out = golden.select(F.col("id").alias("query_id")).join(need, "query_id", "left").join(hits, "query_id", "left")
    return out.select(F.col("query_id").alias("id"), F.when(F.col("_all").isNotNull(), F.coalesce("_h", F.lit(0)) / F.col("_all")).alias("citation_accuracy"))


def hallucinated(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, token): distinct citation tokens of an answer's text whose key no retrieved citation has."""
    said = answers.select("query_id", F.explode(cited_tokens(F.col("text"))).alias("token")).withColumn("key", citation_key(F.col("token")))
    held = retrieved.select("query_id", citation_key(F.col("citation")).alias("key")).distinct()
    return said.join(held, ["query_id", "key"], "left_anti").select("query_id", "token")


def parse_judgement(raw: Column) -> Column:
    """Scores and reasoning of a judge's JSON; what can't be read leaves null scores and the raw text."""
    got = F.from_json(raw, JUDGEMENT)
    readable = F.get_json_object(raw, "$").isNotNull()
    reasoning = F.when(readable, got["reasoning"]).otherwise(F.concat(F.lit("unparseable judge output: "), raw))
    return F.struct(got["groundedness"].alias("groundedness"), got["premise_correction"].alias("premise_correction"), reasoning.alias("reasoning"))


class Judge(Protocol):
    def __call__(self, question: str, answer: str, context: str) -> str: ...


class OverlapJudge:
    """Offline stand-in: an answer is grounded if at least four in five of its longer words stand in the context."""

    def __call__(self, question: str, answer: str, context: str) -> str:
        words = re.findall("[a-z0-9]{6,}", answer.lower())
        held = sum(w in context.lower() for w in words)
        return json.dumps({"groundedness": int(5 * held >= 4 * len(words)), "premise_correction": 1, "reasoning": f"{held} of {len(words)} words"})


def judge(answers: DataFrame, judge_: Judge) -> DataFrame:
    """(query_id, groundedness, premise_correction, judge_reasoning) of (query_id, question, text, context, refused).

    Refusals aren't judged: their scores and reasoning are null.
    """
    kind = dict(answers.dtypes)["query_id"]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            raw = [None if r else judge_(q or "", t or "", c or "") for q, t, c, r in zip(pdf["question"], pdf["text"], pdf["context"], pdf["refused"])]
            yield pd.DataFrame({"query_id": pdf["query_id"], "raw": pd.Series(raw, dtype=object)})

    out = answers.select("query_id", "question", "text", "context", "refused").mapInPandas(run, f"query_id {kind}, raw string")
    j = parse_judgement(F.col("raw"))
    return out.withColumn("j", j).select("query_id", F.col("j.groundedness"), F.col("j.premise_correction"), F.col("j.reasoning").alias("judge_reasoning"))


def summary_columns() -> list[Column]:
    """The numbers of a run: counts, means over what isn't null, rates, and the summed cost."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    refused = F.coalesce("refused", F.lit(False))
    in_scope = F.when(refused, (F.col("category") == "out_of_scope").cast("double"))
    made_up = F.when(F.col("hallucinated_citations").isNotNull(), F.when(F.size("hallucinated_citations") > 0, 1.0).otherwise(0.0))
    return [
        F.count("*").alias("questions"), mean("recall_at_5"), mean("mrr"), mean("citation_accuracy"), mean("groundedness"), mean("premise_correction"),
        F.round(F.avg(made_up), 6).alias("hallucination_rate"), F.round(F.avg(in_scope), 6).alias("refusal_precision"),
        F.count_if(refused).alias("refused"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
    ]


def run_summaries(rows: DataFrame) -> DataFrame:
    """One row for each run; runs that only retrieved have null answer scores."""
    return rows.groupBy("run_id", "config").agg(*summary_columns())


def category_breakdown(rows: DataFrame) -> DataFrame:
    """Per config and category, with a total row (category ``all``) for each config."""
    grouped = rows.groupBy("config", "category").agg(F.sum("recall_at_5").alias("rs"), F.count("recall_at_5").alias("rn"), F.sum("mrr").alias("ms"), F.count("mrr").alias("mn"), F.count("*").alias("n"))
    out = grouped.rollup("config", "category").agg(
        F.sum("n").alias("questions"), F.round(F.sum("rs") / F.nullif(F.sum("rn"), F.lit(0)), 6).alias("recall_at_5"),
        F.round(F.sum("ms") / F.nullif(F.sum("mn"), F.lit(0)), 6).alias("mrr"), F.grouping_id().alias("g"),
    )
    return out.filter("g < 3").select("config", F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("category")).alias("category"), "questions", "recall_at_5", "mrr")
