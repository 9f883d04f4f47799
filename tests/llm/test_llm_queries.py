import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import both  # noqa: E402

from provisio.llm.queries import QUERIES  # noqa: E402
from provisio.llm.sql import ORACLE_SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    got, want = both(spark, sf, QUERIES[name], ORACLE_SQL[name])
    assert got == want


@pytest.mark.parametrize(("name", "columns"), [
    ("p1_found", ["chunk_id", "cut_at"]), ("p2_found", ["chunk_id", "line_no"]), ("p3_found", ["query_id", "chunk_id"]), ("p4_found", ["chunk_id_a", "chunk_id_b"]),
    ("p5_found", ["chunk_id_a", "chunk_id_b"]), ("p6_ids", ["doc_id", "ids"]), ("p7_found", ["doc_id", "item_id"]), ("p8_found", ["doc_id_a", "doc_id_b"]),
])
def test_columns_and_distinct_rows(spark, sf, name, columns):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    df = QUERIES[name](spark, sf)
    assert df.columns == columns
    rows = df.collect()
    assert len(set(map(repr, rows))) == len(rows) > 0
