"""The queries run on the smallest tables with the columns that are asked for."""

import duckdb
import pytest

from marlstone.llm import queries

COLUMNS = {
    "p1_found": ["record_table", "record_key"], "p2_found": ["chunk_id_a", "chunk_id_b"], "p3_found": ["filename", "line_no", "noise_kind"], "p4_found": ["chunk_id_a", "chunk_id_b"], "p5_found": ["chunk_id", "boundary"],
    "p6_found": ["chunk_id", "defect"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = df.collect()
    keys = [c for c in df.columns if c != "ids"]
    if name in COLUMNS:
        assert len({tuple(r[c] for c in keys) for r in rows}) == len(rows)
    if name in queries.ORACLES:
        c = duckdb.connect()
        for t in ("documents", "all_chunks", "all_chunks_embedded", "image_metadata", "size_limits"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        r = c.execute(queries.ORACLES[name])
        order = [x[0] for x in r.description]
        assert sorted(tuple(x) for x in r.fetchall()) == sorted(tuple(x[c] for c in order) for x in rows)
