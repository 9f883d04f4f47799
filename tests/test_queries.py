import math
import os

import pytest
from oracle import both

from provisio.plans.queries import QUERIES
from provisio.plans.sql import ORACLE_SQL
from provisio.sources.corpus import corpus

EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    got, want = both(spark, sf, QUERIES[name], ORACLE_SQL[name])
    assert got == want and (got or name in EMPTY)


def test_contexts_take_all_retrievers(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    chunks = {r.chunk_id: r for r in corpus(spark, sf).collect()}
    lists = {}
    for r in spark.read.parquet(f"{sf}/retrieved.parquet").collect():
        if r.chunk_id in chunks:
            ranks, scores = lists.setdefault((r.query_id, r.retriever), {}).setdefault(r.chunk_id, ([], []))
            ranks += [r.rank] if r.rank is not None else []
            scores += [r.score] if r.score is not None and math.isfinite(r.score) else []
    best = {}
    for (q, name), members in lists.items():
        order = sorted(members, key=lambda c: (-max(members[c][1], default=-math.inf), c))
        for c, (ranks, _) in members.items():
            best.setdefault(q, {}).setdefault(c, {})[name] = min(ranks) if ranks else order.index(c) + 1
    want = {}
    for q, members in best.items():
        names = ("dense", "sparse", "dense+sparse")
        key = lambda c: (-round(sum(1 / (60 + r) for r in members[c].values()), 12), *(members[c].get(n, math.inf) for n in names), c)  # noqa: B023, E731
        want[q] = "\n\n".join(f"[{chunks[c].citation or ''}]\n{chunks[c].text or ''}" for c in sorted(members, key=key)[:5])
    got = {r.query_id: r.context for r in QUERIES["context_build"](spark, sf).collect()}
    assert got == want
    assert {r.query_id for r in QUERIES["prompts"](spark, sf).collect()} == set(want)


def test_entry(spark):
    import __spark_entry__ as e

    if not os.path.isdir(e.SMOKE):
        pytest.skip("no tables here")
    df = e.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "rank", "retriever"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
