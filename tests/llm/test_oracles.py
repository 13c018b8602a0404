"""The opN queries against their DuckDB SQL."""

import duckdb
import pytest

from pathwise.llm import queries
from tests.test_catalog import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_the_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, sf_dir)
    want = c.execute(queries.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, want.fetchall())
