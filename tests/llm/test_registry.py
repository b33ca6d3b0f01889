import duckdb
import pytest

from plumbline.llm import registry

SMALL = "/root/testdata/sf0.001"


def test_sql_is_text_of_registered_queries():
    assert set(registry.SQL) <= set(registry.QUERIES) and all(isinstance(x, str) for x in registry.SQL.values())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "labels"):
        c.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    rel = c.sql(registry.SQL[name])
    df = registry.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    plain = lambda x: repr(round(x, 9)) if isinstance(x, float) else str(x)
    at = [rel.columns.index(k) for k in cols]
    assert sorted(tuple(plain(r[k]) for k in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
