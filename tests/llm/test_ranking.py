import os
import random

import pytest

from provisio.llm import ranking
from provisio.llm.prefix_sums import running_sums
from provisio.llm.queries import QUERIES
from provisio.sources.tables import table

CRIT = "query_id string, chunk_id string, criterion string, score double, place string"


def brute(rows, threshold):
    flows = {}
    queries = {}
    for q, c, k, s, _ in rows:
        if q is None or c is None:
            continue
        queries.setdefault(q, {}).setdefault(k, {})
        flows[q, c] = 0.0
        if k is not None and s is not None and s == s and abs(s) != float("inf"):
            queries[q][k][c] = max(s, queries[q][k].get(c, s))
    for q, crit in queries.items():
        members = [c for a, c in flows if a == q]
        n = len(members)
        for k, known in crit.items():
            if k is None or not known or n < 2:
                continue
            low = min(known.values())
            v = {c: known.get(c, low) for c in members}
            p = {c: (sum(x < v[c] for x in v.values()) + (sum(x == v[c] for x in v.values()) - 1) / 2) / (n - 1) for c in members}
            for c in members:
                flows[q, c] += sum(max(-1.0, min(1.0, (p[c] - x) / threshold)) for x in p.values()) / (n - 1)
    return flows


@pytest.mark.parametrize("threshold", [1.0, 0.4, 0.1])
def test_flows_equal_all_pairs(spark, threshold):
    rnd = random.Random(2)
    rows = []
    for q in ("q1", "q2", "one"):
        for c in range(1 if q == "one" else 15):
            for k, scale in (("a", 1), ("b", 1000), (None, 1)):
                for _ in range(rnd.randint(0, 2)):
                    rows.append((q, f"c{c}", k, rnd.choice([None, float("nan"), float("inf"), rnd.randint(0, 6) * scale * 1.0]), "x"))
            rows.append((q, f"c{c}", "w", 0.4, "x"))
    rows += [(None, "c", "a", 1.0, "x"), ("q1", None, "a", 9.0, "x")]
    df = spark.createDataFrame(rows, CRIT)
    df = df.withColumn("score", ranking.usable(df.score))
    want = brute(rows, threshold)
    got = {(r.query_id, r.chunk_id): r.flow for r in ranking.net_flow(df, threshold=threshold).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_clipped_query_equals_all_pairs(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    criteria = ranking.criteria_from_retrieval(table(spark, sf, "retrieved"), table(spark, sf, "chunks"))
    want = brute([(*r, "x") for r in criteria.select("query_id", "chunk_id", "criterion", "score").collect()], 0.25)
    got = {(r.query_id, r.chunk_id): r.flow for r in QUERIES["p3_clipped"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    plain = {(r.query_id, r.chunk_id): r.flow for r in QUERIES["p3_flows"](spark, sf).collect()}
    assert any(abs(got[k] - plain[k]) > 0.1 for k in want)


def test_places_ties_and_weights(spark):
    rows = [("q", "b", "x", 2.0, ""), ("q", "a", "x", 2.0, ""), ("q", "c", "x", 1.0, ""), ("q", "c", "y", 5.0, ""), ("q", "a", "y", 1.0, ""), ("q", "b", "y", 1.0, "")]
    df = spark.createDataFrame(rows, CRIT)
    order = lambda **k: [r.chunk_id for r in ranking.ranking(df, **k).orderBy("place").collect()]
    assert order(weights={"y": 0.1}) == ["a", "b", "c"]
    assert order(weights={"y": 9.0})[0] == "c"
    assert order(top=1, weights={"y": 0.1}) == ["a"] and order(top=2, weights={"y": 0.1}) == ["a", "b"]
    assert ranking.ranking(df.limit(0)).count() == 0 and ranking.ranking(df.limit(0), top=1).count() == 0
    with pytest.raises(ValueError):
        ranking.net_flow(df, threshold=0)


def test_criteria(spark):
    got = spark.createDataFrame([("q", "a", None, "dense"), ("q", "a", 1.0, "dense"), ("q", "gone", 2.0, "sparse"), ("q", None, 1.0, "dense")], "query_id string, chunk_id string, score double, retriever string")
    chunks = spark.createDataFrame([("a", None), ("a", 0.9), (None, 1.0)], "chunk_id string, authority_weight double")
    rows = {(r.chunk_id, r.criterion): r.score for r in ranking.criteria_from_retrieval(got, chunks).filter("criterion = 'authority'").collect()}
    assert rows == {("a", "authority"): 0.9, ("gone", "authority"): 0.4}


def test_running_sums_over_ties_and_skew(spark):
    rows = [("hot", i, i % 3) for i in range(500)] + [("cold", 1, 5), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r.g, r.o): r.s for r in running_sums(df, ["g"], "o", {"s": "v"}).collect()}
    total = 0
    for i in range(500):
        total += i % 3
        assert got["hot", i] == total
    assert got["cold", 1] == 5 and got["none", 1] == 0 and len(got) == 502
    assert running_sums(df.limit(0), ["g"], "o", {"s": "v"}).count() == 0
