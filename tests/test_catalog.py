"""Every registered query of the sequence operators against its DuckDB SQL, on whole small tables."""

import math
from collections import Counter

import duckdb
import pytest

from pathwise.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def key(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0 if math.isfinite(v) else v
    return v


def rows(columns, got):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(key(r[i]) for i in order) for r in got)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_the_sql(spark, duck, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalog.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = rows(columns, want.fetchall())
    assert rows(frame.columns, frame.collect()) == expected
    assert expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    assert frame.columns and frame.count() > 0
