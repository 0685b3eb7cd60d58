"""Every query of the catalogue against its SQL in DuckDB, on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as engine
from palimpsest.plans import catalog, catalog_index, catalog_more, catalog_options, catalog_records, catalog_upkeep  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, (str, bool)):
            return v
        v = round(float(v), 9)
        return None if math.isnan(v) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    assert columns == sorted(names)
    want = plain([[r[names.index(c)] for c in columns] for r in result.fetchall()])
    assert plain(df.select(*columns).collect()) == want


def test_entry_points(spark):
    assert engine.entry(spark).count() > 0
    assert set(engine.oracle_sql()) <= set(engine.queries()) and set(catalog.QUERIES) <= set(engine.queries())
