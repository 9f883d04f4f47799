import math
import random

import pytest

from provisio.functions.text import STOPWORDS
from provisio.operators import bm25, dense, fusion, lookup
from provisio.operators.embed import HashingEmbedder, embedded
from provisio.plans.pipeline import PipelineConfig, retrieve

CHUNK = "chunk_id string, text string, citation string, authority_weight double, tax_year_start int, tax_year_end int, pos long"


def corpus(spark, rows):
    return spark.createDataFrame([(c, t, x, w, None, None, i) for i, (c, t, x, w) in enumerate(rows)], CHUNK)


def brute_bm25(docs, question, k):
    docs = [[w for w in d.lower().split() if w not in STOPWORDS] for d in docs]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    scores = []
    for d in docs:
        s = 0.0
        for w in [w for w in question.lower().split() if w not in STOPWORDS]:
            tf = d.count(w)
            s += idf.get(w, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        scores.append(round(s, 9))
    return sorted(range(n), key=lambda i: (-scores[i], i))[:k], scores


def test_bm25_equals_brute_force_with_ties_and_zero_scores(spark):
    rnd = random.Random(5)
    words = "tax home office meal log mile rent cost share year".split()
    docs = [" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(40)] + ["tax tax"] * 3 + [""]
    rows = corpus(spark, [(f"c{i}", t, "x", 1.0) for i, t in enumerate(docs)])
    asked = ["tax home", "rent rent cost the", "unknown words", "log"]
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "query_id string, question string")
    got = {}
    for r in bm25.top_k(bm25.build(rows), q, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (int(r.chunk_id[1:]), r.score)
    for i, text in enumerate(asked):
        order, scores = brute_bm25(docs, text, 7)
        assert [got[str(i)][n + 1][0] for n in range(7)] == order
        assert all(abs(got[str(i)][n + 1][1] - scores[d]) < 1e-8 for n, d in enumerate(order))
    few = bm25.top_k(bm25.build(rows.limit(3)), q, 7).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {3}


def test_dense_top_k_skips_unusable_vectors_and_breaks_ties(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", []), ("f", [0.0, 0.0]), ("g", [float("nan"), 1.0]), ("h", [1.0, None])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("bad", [0.0, 0.0])], "query_id string, embedding array<float>")
    for block in (1, 100):
        got = [(r.query_id, r.id, r["rank"]) for r in dense.top_k(df, q, 2, dim=2, id_col="id", vec_col="v", query_block=block).orderBy("rank").collect()]
        assert got == [("q", "a", 1), ("q", "b", 2)]
    assert dense.top_k(df.limit(0), q, 2, dim=2, id_col="id", vec_col="v").count() == 0
    assert dense.top_k(df, q.limit(0), 2, dim=2, id_col="id", vec_col="v").count() == 0


def ranks(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, retriever string")


def test_rrf_ties_and_provenance(spark):
    d = ranks(spark, [("q", "a", 1, "dense"), ("q", "b", 2, "dense"), ("q", "n", None, "dense")])
    s = ranks(spark, [("q", "c", 1, "sparse"), ("q", "b", 2, "sparse")])
    got = [tuple(r) for r in fusion.reciprocal_rank_fusion([d, s]).orderBy("rank").collect()]
    assert [(r[1], r[3], r[4]) for r in got] == [("b", 1, "dense+sparse"), ("a", 2, "dense"), ("c", 3, "sparse")]
    assert abs(got[0][2] - 2 / 62) < 1e-9


def test_prioritise_drops_duplicates_and_keeps_scores(spark):
    found = spark.createDataFrame([("q", "x", 1), ("q", "b", 2)], "query_id string, chunk_id string, ord int")
    ranked = spark.createDataFrame([("q", "a", 0.5, 1, "dense"), ("q", "b", 0.4, 2, "dense"), ("p", "a", 0.3, 1, "dense")], "query_id string, chunk_id string, score double, rank int, retriever string")
    got = sorted(tuple(r) for r in fusion.prioritise(found, ranked).collect())
    assert got == [("p", "a", 0.3, 1, "dense"), ("q", "a", 0.5, 3, "dense"), ("q", "b", 1.0, 2, "citation"), ("q", "x", 1.0, 1, "citation")]


@pytest.fixture(scope="module")
def statutes(spark):
    names = ["IRC §1401(b)(2)(B)", "IRC §1401(b)(2)(A)(i)", "IRC §1401(b)(2)(A)(ii)", "IRC §1401(b)(2)(A)(iii)", "IRC §1401(b)(1)", "IRC §1401(c)",
             "IRC §14010(b)(2)(C)", "Treas. Reg. §1.274-5(a)", "Pub. 587 — Homes", "IRC §179", "IRC §1401(b)(2)(B)(x)", "IRC §1401(c)"]
    return corpus(spark, [(f"c{i}", "t", n, 1.0) for i, n in enumerate(names)])


def look(spark, chunks, text):
    q = spark.createDataFrame([("q", text)], "query_id string, question string")
    return [r.chunk_id for r in lookup.lookup(q, chunks).orderBy("ord").collect()]


def test_lookup_scopes(spark, statutes):
    assert look(spark, statutes, "What does IRC §1401(b)(2) say?") == ["c0", "c1", "c2", "c3"]  # uneven depth
    assert look(spark, statutes, "IRC §1401(b)(2)(B)") == ["c0", "c10"]  # itself and what is below
    assert look(spark, statutes, "IRC §1401(b)(2)(B)(x)") == ["c10", "c0"]  # a leaf and its parent
    assert look(spark, statutes, "IRC §1401(b)(1)") == ["c4"]  # no parent chunk
    assert look(spark, statutes, "IRC §1401(c)") == ["c11"]  # the last of one provision
    assert look(spark, statutes, "IRC §179") == ["c9"]
    assert look(spark, statutes, "IRC §999") == []
    assert look(spark, statutes, "no citation") == []


def test_pipeline_flags(spark, statutes):
    q = spark.createDataFrame([("q", "IRC §179 t")], "query_id string, question string")
    with pytest.raises(ValueError):
        retrieve(q, statutes, PipelineConfig(use_dense=False, use_sparse=False))
    assert PipelineConfig().pool == 5 and PipelineConfig(use_rerank=True).pool == 20 and PipelineConfig(use_sparse=True).pool == 20
    e = HashingEmbedder(16)
    vectors = embedded(statutes.select("chunk_id", "text"), e).select("chunk_id", "embedding")
    for config in (PipelineConfig(), PipelineConfig(use_sparse=True), PipelineConfig(use_dense=False, use_sparse=True, filter_tax_year=False, order_by_authority=True)):
        rows = retrieve(q, statutes, config, vectors=vectors, embedder=e).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and rows[0].chunk_id == "c9" and len({r.chunk_id for r in rows}) == 5


def test_tax_years_in_either_order(spark):
    chunks = spark.createDataFrame([("a", 2020, 2010), ("b", None, 2000), ("c", None, None)], "chunk_id string, tax_year_start int, tax_year_end int")
    ranked = spark.createDataFrame([("q", c, 1.0, i, "dense") for i, c in enumerate("abc", 1)], "query_id string, chunk_id string, score double, rank int, retriever string")
    years = spark.createDataFrame([("q", 2015)], "query_id string, tax_year int")
    assert [r.chunk_id for r in fusion.in_force(ranked, chunks, years).orderBy("rank").collect()] == ["a", "c"]
