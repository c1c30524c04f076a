"""Every registered query against its SQL on the same tables."""

import duckdb
import pandas as pd
import pytest

from immunoframe.plans.oracles import ORACLE_SQL
from immunoframe.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else float(f"{x:.8g}") if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in row) for row in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert canonical(got) == canonical(want)
