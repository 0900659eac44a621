"""Every registered query of the training-data operators on the smallest tables."""

from pathlib import Path

import pytest

from stratakb.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
COLUMNS = {
    "p1_found": "chunk_id field",
    "p2_found": "chunk_id_a chunk_id_b",
    "p3_found": "chunk_id_a chunk_id_b",
    "p4_found": "record_table record_id",
    "p5_found": "chunk_id line_no",
    "p6_ids": "doc_id ids",
    "p8_found": "doc_id",
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in ("p2_found", "p3_found"):
        assert all(a < b for a, b in rows)
