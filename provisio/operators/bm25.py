"""Okapi BM25 over a corpus of texts, many questions at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions.text import tokens
from provisio.operators.best import Best
from provisio.runtime import broadcast_if_small, cut

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Steps of a matrix product that cost as much as one of a scattered sum.
DENSE_GAIN = 300


@dataclass
class Index:
    """docs (chunk_id, pos, dl, words); terms (term, df, idf); stats: one row (n, avgdl)."""

    docs: DataFrame
    terms: DataFrame
    stats: DataFrame


def build(corpus: DataFrame) -> Index:
    """Tokenise once: the documents and the term table are written before they are used several times."""
    docs = cut(corpus.select("chunk_id", "pos", tokens(F.col("text")).alias("words")).withColumn("dl", F.size("words")))
    stats = docs.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    df = docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = cut(df.join(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.lit(FLOOR) * F.col("mean")).otherwise(F.col("raw"))
    return Index(docs, raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf")), stats)


def postings(index: Index) -> DataFrame:
    """(term, chunk_id, tf, dl): how often each term stands in each document."""
    held = index.docs.select("chunk_id", "dl", F.explode("words").alias("term"))
    return held.groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf")).select("term", "chunk_id", "tf", "dl")


def top_k(index: Index, questions: DataFrame, k: int, *, question_block: int = 1024) -> DataFrame:
    """(query_id, chunk_id, score, rank, retriever): the best ``k`` of the whole corpus for each question.

    Words that a question repeats count repeatedly. Chunks that share no word score 0 and fill up
    in corpus order. Scores are compared at 9 digits, ties go to the earlier chunk.

    Nothing but results is shuffled: the weights of the questions' words go to the tasks, each
    task scores its chunks and keeps its own best ``k`` of every question. Questions are taken in
    blocks of ``question_block``, one pass over the corpus each.
    """
    spark = questions.sparkSession
    q_kind = dict(questions.dtypes)["query_id"]
    n, avgdl = index.stats.collect()[0]
    block = questions.select("query_id", tokens(F.col("question")).alias("words")).toLocalIterator(prefetchPartitions=True)
    out = None
    while True:
        got = [r for _, r in zip(range(question_block), block)]
        if not got and out is not None:
            break
        vocabulary = sorted({w for r in got for w in r["words"]})
        wanted = spark.createDataFrame([(w,) for w in vocabulary], "term string")
        idf = {r["term"]: r["idf"] for r in index.terms.join(broadcast_if_small(wanted, 1_000_000), "term").collect()}  # the questions' words only
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in got], *_weights([r["words"] for r in got], idf)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, terms, first, who, weight = sent.value
            best = Best(len(ids), k)
            for b in batches:
                for a in range(0, b.num_rows, 1000):
                    part = b.slice(a, 1000)
                    best.add(np.array(part.column(0).to_pylist(), object), part.column(1).to_numpy(), _scores(part, terms, first, who, weight, len(ids), avgdl).T)
            q, chunk, pos, score = best.rows()
            for a in range(0, len(q), 50_000):
                at = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q[at]]), pa.array(chunk[at], pa.string()), pa.array(pos[at]), pa.array(score[at])], names=["query_id", "chunk_id", "pos", "score"])

        part = index.docs.select("chunk_id", "pos", "dl", "words").mapInArrow(run, f"query_id {q_kind}, chunk_id string, pos long, score double")
        out = part if out is None else out.unionByName(part)
        if len(got) < question_block:
            break
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "score", "rank", F.lit("sparse").alias("retriever"))


def _weights(words: list[list[str]], idf: dict[str, float]) -> tuple:
    """(terms, first, who, weight): the questions ``who[first[t]:first[t + 1]]`` have term t with that weight."""
    held = Counter((w, i) for i, ws in enumerate(words) for w in ws if w in idf)
    terms = sorted({w for w, _ in held})
    number = {w: t for t, w in enumerate(terms)}
    rows = sorted((number[w], i, c * idf[w]) for (w, i), c in held.items())
    first = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(len(terms) + 1))
    return pa.array(terms, pa.string()), first, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64)


def _scores(part: pa.RecordBatch, terms: pa.Array, first: np.ndarray, who: np.ndarray, weight: np.ndarray, questions: int, avgdl: float) -> np.ndarray:
    """Scores of the chunks of a batch (pos, dl and words in its columns 1 to 3), one row each."""
    n = part.num_rows
    words = part.column(3)
    doc = np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))
    term = pc.index_in(words.flatten(), value_set=terms)
    known = pc.is_valid(term).to_numpy(zero_copy_only=False)
    pair, tf = np.unique(doc[known] * (len(terms) + 1) + term.drop_null().to_numpy(), return_counts=True)
    doc, term = pair // (len(terms) + 1), pair % (len(terms) + 1)
    dl = part.column(2).to_numpy()[doc]
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)) if len(tf) else np.zeros(0)
    count = first[term + 1] - first[term]
    if n * len(terms) * questions < DENSE_GAIN * count.sum():  # many shared words: a matrix product is cheaper
        gains, weights = np.zeros((n, len(terms))), np.zeros((len(terms), questions))
        gains[doc, term] = gain
        weights[np.repeat(np.arange(len(terms)), np.diff(first)), who] = weight
        return np.round(gains @ weights, 9)
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[term] - (ends - count), count)
    cell = np.repeat(doc, count) * questions + who[at]
    total = np.bincount(cell, weights=np.repeat(gain, count) * weight[at], minlength=n * questions)
    return np.round(total.reshape(n, questions), 9)
