"""The registered queries against their SQL on the smallest driver tables."""

import duckdb
import pytest

from tissueflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(name, spark):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    q = c.execute(queries.ORACLE[name])
    columns = [d[0] for d in q.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(("",) if v is None else (round(v, 9),) if isinstance(v, float) else (str(v),) for v in r)
    assert sorted(key(r) for r in map(tuple, got.select(*columns).collect())) == sorted(key(r) for r in q.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
