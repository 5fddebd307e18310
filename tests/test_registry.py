import pytest

duckdb = pytest.importorskip("duckdb")
from quillstone import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "events"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sql, name):
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in found.collect())
    assert rows
    want = sql.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(ORACLES) == set(registry.queries())
