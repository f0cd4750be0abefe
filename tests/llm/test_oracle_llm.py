"""The queries that SQL can express against their SQL, over a small folder of the given tables."""

import duckdb
import pytest

from docweave.llm import queries


@pytest.mark.parametrize("name", ["op11_recursive_merkle_climb", "op12_iterative_deepening_repair", "op13_lsh_forest_minhash"])
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
