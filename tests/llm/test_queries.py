"""Each query with SQL, against DuckDB over the same files."""

import os

import duckdb
import pytest

from evigraph.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{'/*.parquet' * os.path.isdir(f'{sf_dir}/{t}.parquet')}'")
    expected = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in expected.description)
    rows = [dict(zip([c[0] for c in expected.description], r)) for r in expected.fetchall()]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    taken = lambda rs: sorted(([plain(r[c]) for c in columns] for r in rs), key=str)
    assert taken(df.collect()) == taken(rows)
