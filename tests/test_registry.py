"""Every registered query of the library against its SQL on the smallest driver tables."""

import duckdb
import pandas as pd
import pytest

from tissueflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    return sorted(tuple("~" if pd.isna(v) else f"{float(v) + 0.0:.5f}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE:
        assert len(got)
        return
    want = duck.execute(registry.ORACLE[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_all_have_sql_but_those_that_cannot():
    without = {"a17_highly_variable", "a18_common_highly_variable", "m1_cluster_embeddings", "m2_medoid_types", "j11_visited_share"}
    assert set(registry.QUERIES) - set(registry.ORACLE) == without
