import duckdb
import pytest

from tessera.plans import registry

from .conftest import DATA

NAMES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/sf0.001/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    rel = duck.sql(registry.oracle_sql()[name])
    want_names = sorted(rel.columns)
    assert sorted(got.columns) == want_names
    table = got.select(*[f"`{c}`" for c in want_names]).collect()
    at = [rel.columns.index(c) for c in want_names]
    want = [tuple(r[k] for k in at) for r in rel.fetchall()]
    assert sorted(map(repr, map(tuple, table))) == sorted(map(repr, want))
