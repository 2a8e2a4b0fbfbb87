"""Every registered shop query against its SQL on the smallest tables."""

import duckdb
import pytest

from brookmill.oracles import ORACLES
from brookmill.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(columns, data, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in data), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect(), sorted(columns)) == rows(columns, cursor.fetchall(), sorted(columns))
