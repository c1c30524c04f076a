"""Registered queries of this subpackage against their SQL on the same tables."""

import duckdb
import pytest

from immunoframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    rows = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
