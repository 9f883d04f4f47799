from pathlib import Path

import pytest
from pyspark.sql import functions as F

from provisio.operators import answer, metrics, runs
from provisio.streaming.questions import serve

ANSWER, HELD = "query_id string, text string", "query_id string, citation string"


def cited(spark, text, held):
    a = spark.createDataFrame([("q", text)], ANSWER)
    h = spark.createDataFrame([("q", c) for c in held], HELD)
    return answer.grounded_citations(a, h).collect()[0].citations


def test_grounded_citations(spark):
    pubs = [f"Pub. 463 — Part {i}" for i in range(5)]
    assert cited(spark, "Meals count (Pub. 463).", pubs) == ["Pub. 463"]  # no fan-out
    assert cited(spark, "See Pub. 463 — Part 2.", pubs) == ["Pub. 463"]  # the short form only
    assert cited(spark, "(Treas. Reg. §1.274-5(c)(2))", ["Treas. Reg. §1.274-5(c)(2)(i)"]) == ["Treas. Reg. §1.274-5(c)(2)"]
    assert cited(spark, "IRC §61 says so", ["IRC §280A"]) == []
    assert cited(spark, "IRC §162, then §162 again", ["IRC §162(a)"]) == ["IRC §162"]
    assert cited(spark, "§280A first, IRC §162 second", ["IRC §162(a)", "IRC §280A"]) == ["§280A", "IRC §162"]
    assert cited(spark, "under §280A(c)(1)", ["IRC §280A(c)(1)"]) == ["§280A(c)(1)"]
    assert cited(spark, "as IRC 1401(b) has it", ["IRC §1401(b)"]) == []
    assert cited(spark, "Pub. 5", []) == []


def test_hallucination_needs_equal_keys(spark):
    a = spark.createDataFrame([("q", "§280A and Pub. 587 and §99 and §99"), ("p", None)], ANSWER)
    h = spark.createDataFrame([("q", "IRC §280A(c)(1)"), ("q", "Pub. 587 — x")], HELD)
    assert sorted(r.token for r in metrics.hallucinated(a, h).collect()) == ["§280A", "§99"]


GOLDEN = "id string, category string, question string, draft_citation string"


def test_recall_and_rank(spark):
    g = spark.createDataFrame([("a", "x", "?", "IRC §16; Pub. 5"), ("b", "out_of_scope", "?", "none"), ("c", "x", "?", "Form 9"), ("d", "x", "?", None)], GOLDEN)
    ranked = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("c", "1", 1)], "query_id string, chunk_id string, rank int")
    chunks = spark.createDataFrame([("1", "Pub. 7"), ("2", "IRC §162(a)")], "chunk_id string, citation string")
    got = {r.id: (r.recall, r.mrr) for r in metrics.retrieval_scores(g, ranked, chunks).collect()}
    assert got == {"a": (0.5, 0.5), "b": (None, None), "c": (0.0, 0.0), "d": (None, None)}  # a prefix matches as text
    said = spark.createDataFrame([("a", ["§16", "Pub. 5"])], "query_id string, citations array<string>")
    assert {r.id: r.citation_accuracy for r in metrics.citation_accuracy(g, said).collect()} == {"a": 1.0, "b": None, "c": 0.0, "d": None}


def test_judgement(spark):
    rows = [('{"groundedness": 1, "premise_correction": 0, "reasoning": "r"}',), ('{"groundedness": 1}',), ("not json",), (None,)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "raw string").select(metrics.parse_judgement(F.col("raw"))).collect()]
    assert got == [(1, 0, "r"), (1, None, None), (None, None, "unparseable judge output: not json"), (None, None, None)]


def test_summaries(spark):
    schema = "run_id string, config string, category string, recall_at_5 double, mrr double, citation_accuracy double, groundedness int, premise_correction int, hallucinated_citations array<string>, refused boolean, cost_usd double"
    rows = [("r", "h", "x", 1.0, 0.5, None, 1, 1, ["a"], False, 0.1), ("r", "h", "out_of_scope", None, None, None, None, None, [], True, 0.0), ("r", "h", "x", 0.0, 0.0, 1.0, 0, 1, None, True, None)]
    r = metrics.run_summaries(spark.createDataFrame(rows, schema)).collect()[0]
    assert (r.questions, r.recall_at_5, r.mrr, r.citation_accuracy, r.groundedness, r.hallucination_rate, r.refusal_precision, r.refused, r.cost_usd) == (3, 0.5, 0.25, 1.0, 0.5, 0.5, 0.5, 2, 0.1)
    by = {x.category: (x.questions, x.recall_at_5) for x in metrics.category_breakdown(spark.createDataFrame(rows, schema)).collect()}
    assert by == {"all": (3, 0.5), "x": (2, 0.5), "out_of_scope": (1, None)}


def test_runs(spark):
    rows = spark.createDataFrame([("d1", "d", "a", 1), ("d2", "d", "a", 3), ("h1", "h", "b", 2)], "run_id string, config string, id string, scored_at int")
    last = runs.latest_runs(rows)
    assert {r.config: r.run_id for r in last.collect()} == {"d": "d2", "h": "h1"}
    g = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(tuple(r) for r in runs.remaining(g, rows, last).collect()) == [("d", "b"), ("h", "a")]
    files = spark.createDataFrame([("/x/hybrid_20260101T0.json", 1), ("/x/hybrid_20260102T0.json", 2), ("/x/hybrid_retrievalonly_2026.json", 9)], "path string, modified int")
    assert runs.latest_run_file(files, "hybrid").collect()[0].path == "/x/hybrid_20260102T0.json"


def test_drift(spark):
    c = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    v = spark.createDataFrame([("b", 1, [1.0]), ("b", 2, None), ("z", 1, [2.0])], "chunk_id string, embedded_at int, embedding array<float>")
    assert sorted(tuple(r) for r in runs.drift(c, v).collect()) == [("a", "missing"), ("z", "stale")]
    assert {r.chunk_id: r.embedding for r in runs.upserted(v).collect()} == {"b": None, "z": [2.0]}
    with pytest.raises(Exception, match="out of step"):
        runs.require_no_drift(c, v).collect()
    assert runs.require_no_drift(c, v.filter("chunk_id = 'b'").unionByName(v.filter("chunk_id = 'z'").withColumn("chunk_id", F.lit("a")))).count() == 3


def test_answers(spark):
    q = spark.createDataFrame([("q", "household employer payroll records"), ("n", "nothing fits")], "query_id string, question string")
    chunks = spark.createDataFrame([("c", "The household employer keeps payroll records. More.", "IRC §7(a)")], "chunk_id string, text string, citation string")
    ranked = spark.createDataFrame([("q", "c", 1)], "query_id string, chunk_id string, rank int")
    got = {r.query_id: r for r in answer.answers(q, ranked, chunks, answer.ExtractiveGenerator()).collect()}
    assert got["q"].citations == ["IRC §7(a)"] and not got["q"].refused and got["q"].refusal_reason is None
    assert got["n"].refused and got["n"].refusal_reason == answer.REFUSAL_REASON and got["n"].citations == []
    asked = spark.createDataFrame([("q", "?", "t", "c", False), ("n", "?", "t", "c", True)], "query_id string, question string, text string, context string, refused boolean")
    judged = {r.query_id: r.groundedness for r in metrics.judge(asked, metrics.OverlapJudge()).collect()}
    assert judged["n"] is None and judged["q"] is not None


def test_stream_appends_each_question_once(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "x"), ("b", "y")], "query_id string, question string").write.parquet(str(src))
    stream = spark.readStream.schema("query_id string, question string").parquet(str(src))
    run = lambda: serve(stream, lambda b: b.select("query_id"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    run()
    run()  # nothing new
    assert sorted(r.query_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    assert Path(tmp_path / "cp").exists()


def test_registry_of_queries():
    from provisio.plans.queries import QUERIES
    from provisio.plans.sql import ORACLE_SQL

    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE_SQL)
