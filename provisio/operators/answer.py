"""Around an answer: context, prompt, generation by a plug-in, grounded citations, refusal."""

from __future__ import annotations

import re
import time
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions.citations import mention_key, mentions, prefixes
from provisio.functions.text import tokens
from provisio.runtime import cut

LONG_WORD = re.compile("[a-z0-9]{5,}")
REFUSAL = "INSUFFICIENT_CONTEXT"
REFUSAL_REASON = "insufficient context"
ANSWER = (
    "query_id {kind}, text string, citations array<string>, refused boolean, refusal_reason string, "
    "trace struct<latency_s:double,prompt_tokens:int,completion_tokens:int,total_tokens:int,cost_usd:double,model:string>"
)
INSTRUCTIONS = (
    "Answer only from the numbered source excerpts that follow the question. Put the exact citation, copied from "
    "its excerpt, in parentheses after each claim, and cite nothing else. If the excerpts do not answer the question, "
    "reply with exactly: {refusal}. State what the authority provides; give no advice."
)


def contexts(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): blocks ``[citation]`` + line end + text, in rank order, a blank line between."""
    rows = ranked.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "citation", "text"), "chunk_id")
    block = F.concat(F.lit("["), F.coalesce("citation", F.lit("")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    parts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", block.alias("b")))).alias("p"))
    return parts.select("query_id", F.array_join(F.col("p.b"), "\n\n").alias("context"))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(INSTRUCTIONS.format(refusal=REFUSAL) + "\n\nSource excerpts:\n\n"), context, F.lit("\n\nQuestion: "), question)


def is_refusal(text: Column) -> Column:
    return F.coalesce(text.contains(REFUSAL), F.lit(False))


def grounded_mentions(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, mention, ord) of citations in an answer that retrieved chunks bear out.

    answers: (query_id, text); retrieved: (query_id, citation). A mention counts if its key begins
    a retrieved key or the other way round; of equal keys the first mention stays, as written.
    Keys are short, so prefixes are exploded and matched by equality.
    """
    said = answers.select("query_id", F.posexplode(mentions(F.col("text"))).alias("at", "mention")).withColumn("key", mention_key(F.col("mention")))
    first = said.groupBy("query_id", "key").agg(F.min_by("mention", "at").alias("mention"), F.min("at").alias("at"))
    held = retrieved.select("query_id", mention_key(F.col("citation")).alias("rk")).filter("rk is not null").distinct()
    up = first.join(held.select("query_id", F.explode(prefixes(F.col("rk"))).alias("key")).distinct(), ["query_id", "key"], "left_semi").select("query_id", "key")
    down = first.select("query_id", "key", F.explode(prefixes(F.col("key"))).alias("rk")).join(held, ["query_id", "rk"], "left_semi").select("query_id", "key")
    out = first.join(up.unionByName(down).distinct(), ["query_id", "key"], "left_semi")
    return out.select("query_id", "mention", F.col("at").alias("ord"))


def grounded_citations(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, citations) in order of appearance, the empty list for answers without any."""
    found = grounded_mentions(answers, retrieved).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "mention"))).alias("m"))
    out = answers.select("query_id").join(found, "query_id", "left")
    return out.select("query_id", F.coalesce(F.col("m.mention"), F.array().cast("array<string>")).alias("citations"))


class Generator(Protocol):
    model: str

    def __call__(self, question: str, context: str) -> str: ...


class ExtractiveGenerator:
    """Offline stand-in: of the first blocks that have one, the first sentence that shares two longer words with the question, and its citation."""

    model = "extractive"
    blocks = 3

    def __call__(self, question: str, context: str) -> str:
        asked = set(LONG_WORD.findall(question.lower()))
        out = []
        for block in context.split("\n\n["):
            head, _, body = block.removeprefix("[").partition("]\n")
            fits = (s for s in body.split(". ") if len(asked.intersection(LONG_WORD.findall(s.lower()))) >= 2)
            if (sentence := next(fits, None)) is not None:
                out.append(f"{sentence} ({head}).")
        return " ".join(out[: self.blocks]) or REFUSAL


def generate(inputs: DataFrame, generator: Generator) -> DataFrame:
    """(query_id, raw, latency_s, prompt_tokens, completion_tokens) for (query_id, question, context)."""
    kind = dict(inputs.dtypes)["query_id"]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for i, q, c in zip(pdf["query_id"], pdf["question"], pdf["context"]):
                began = time.time()
                text = generator(q or "", c or "").strip()
                rows.append((i, text, round(time.time() - began, 2), len((q or "").split()) + len((c or "").split()), len(text.split())))
            yield pd.DataFrame(rows, columns=["query_id", "raw", "latency_s", "prompt_tokens", "completion_tokens"])

    return inputs.select("query_id", "question", "context").mapInPandas(run, f"query_id {kind}, raw string, latency_s double, prompt_tokens int, completion_tokens int")


def answers(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, generator: Generator) -> DataFrame:
    """The answer row of each question: text, grounded citations, refusal and trace."""
    context = contexts(ranked, chunks)
    raw = cut(generate(questions.join(context, "query_id", "left"), generator))  # each question is asked once
    held = ranked.select("query_id", "chunk_id").join(chunks.select("chunk_id", "citation"), "chunk_id")
    cited = grounded_citations(raw.select("query_id", F.col("raw").alias("text")), held)
    refused = is_refusal(F.col("raw"))
    trace = F.struct("latency_s", "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.lit(0.0).alias("cost_usd"), F.lit(generator.model).alias("model"))
    return raw.join(cited, "query_id").select(
        "query_id", F.col("raw").alias("text"), "citations", refused.alias("refused"), F.when(refused, F.lit(REFUSAL_REASON)).alias("refusal_reason"), trace.alias("trace")
    )


def overlap_words(question: Column, text: Column) -> Column:
    """Distinct index words that a question and a text share."""
    return F.size(F.array_intersect(tokens(question), tokens(text)))
