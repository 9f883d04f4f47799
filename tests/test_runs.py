import os
import sys

import pytest

from provisio.plans import evaluate
from provisio.plans.evaluate import run
from provisio.sources.config import load_env


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    golden = [("q1", "factual_lookup", "What may a household employer deduct under IRC §7(a)?", "IRC §7(a)", 2022, None), ("q2", "out_of_scope", "weather?", "none", None, None), ("q3", "multi_hop", "payroll records", "Pub. 5", None, None)]
    spark.createDataFrame(golden, "id string, category string, question string, draft_citation string, tax_year int, reference_answer string").write.parquet(f"{base}/golden_set.parquet")
    chunks = [("irc-7-a", "IRC §7 > (a) — A household employer may deduct wages.", "IRC §7(a)", 0), ("pub-5", "Pub. 5 > Records — Keep payroll records.", "Pub. 5 — Records", 1), ("irc-8", None, "IRC §8", 2)]
    df = spark.createDataFrame([(c, t, x, "statute", 1.0, None, None, "u", p, 1) for c, t, x, p in chunks], "chunk_id string, text string, citation string, source_type string, authority_weight double, tax_year_start int, tax_year_end int, url string, pos long, ingested_at int")
    df.unionByName(df).write.parquet(f"{base}/chunks.parquet")
    return str(base)


def test_run_limit_and_resume(spark, tables, tmp_path):
    out = str(tmp_path / "runs")
    first = run(spark, tables, out, "bm25_only", limit=1, resume=True).collect()[0]  # nothing to go on with
    assert (first.questions, first.recall_at_5, first.mrr) == (1, 1.0, 1.0) and first.groundedness is not None
    again = run(spark, tables, out, "bm25_only", resume=True).collect()[0]
    assert again.run_id == first.run_id and again.questions == 3
    assert run(spark, tables, out, "bm25_only", resume=True).collect()[0].questions == 3  # already complete
    only = run(spark, tables, out, "hybrid", retrieval_only=True).collect()[0]
    assert only.questions == 3 and only.groundedness is None and only.hallucination_rate is None and "_retrievalonly_" in only.run_id
    # a retrieval-only run isn't taken for the one to go on with
    assert run(spark, tables, out, "bm25_only", retrieval_only=True, resume=True).collect()[0].run_id != first.run_id


def test_env_file(tmp_path):
    (tmp_path / ".env").write_text("# no\nA=1\n B = 'two' \n\nKEPT=new\nbroken\n")
    env = {"KEPT": "old"}
    assert load_env(str(tmp_path / ".env"), env) == {"A": "1", "B": "two"} and env == {"KEPT": "old", "A": "1", "B": "two"}
    assert load_env(str(tmp_path / "none"), env) == {}


def failing(path, most, error):
    """A generator that answers a few questions and then fails; every task starts anew, so it counts in a file."""

    class Failing:
        model = "failing"

        def __call__(self, question, context):
            with open(path, "a+") as f:
                f.write("x")
                f.flush()
                if os.path.getsize(path) > most:
                    raise error("no more")
            return "INSUFFICIENT_CONTEXT"

    return Failing()


def test_blocks_are_kept_when_a_generator_fails(spark, sf, tmp_path):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    out = str(tmp_path / "out")
    how = {"limit": 40, "block": 10}
    with pytest.raises(Exception, match="no more"):
        evaluate.run(spark, sf, out, "bm25_only", generator=failing(str(tmp_path / "n1"), 30, KeyError), **how)
    kept = spark.read.parquet(out).select("id").collect()
    assert 5 < len(kept) < 40
    # a limit ends the run quietly, in the same run
    summary = evaluate.run(spark, sf, out, "bm25_only", resume=True, generator=failing(str(tmp_path / "n2"), 1, evaluate.RateLimited), **how).collect()
    assert summary[0].questions == len(kept)
    summary = evaluate.run(spark, sf, out, "bm25_only", resume=True, generator=failing(str(tmp_path / "n3"), 10**6, KeyError), **how).collect()
    rows = spark.read.parquet(out)
    assert len(summary) == 1 and summary[0].questions == 40 == rows.select("id").distinct().count() == rows.count()


def test_a_run_stopped_at_once_has_no_summary(spark, sf, tmp_path):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    got = evaluate.run(spark, sf, str(tmp_path / "out"), "bm25_only", limit=5, generator=failing(str(tmp_path / "n"), 0, evaluate.RateLimited))
    assert got.count() == 0


def test_command_line(spark, tables, tmp_path, monkeypatch):
    out = str(tmp_path / "runs")
    monkeypatch.setattr(sys, "argv", ["evaluate", "--data", tables, "--out", out, "--config", "hybrid", "--limit", "2", "--retrieval-only"])
    evaluate.main()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 2 and {r.config for r in rows} == {"hybrid"} and all(r.retrieval_only for r in rows)
