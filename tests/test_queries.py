"""Each query against its SQL in DuckDB over the same files."""

import os

import duckdb
import pytest

from evigraph.library_queries import ROWS_ONLY
from evigraph.oracle import ORACLES
from evigraph.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | set(ROWS_ONLY)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_pixel_queries_have_their_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{'/*.parquet' * os.path.isdir(f'{sf_dir}/{t}.parquet')}'")
    expected = con.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    rows = expected.fetchall()
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    taken = lambda rs: sorted(([plain(x) for x in r] for r in rs), key=str)
    assert taken([r[c] for c in names] for r in df.collect()) == taken(rows)
