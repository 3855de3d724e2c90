"""Every corpus query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pytest

from attestra.llm.oracles import ORACLES
from attestra.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "documents pages labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(df):
    plain = lambda x: None if x is None or x != x else round(float(x), 9) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
