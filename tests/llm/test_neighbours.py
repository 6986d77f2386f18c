import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tissueflow.llm import neighbours as nn


def rows_of(frame, **options):
    return [tuple(r) for r in nn.nearest(frame, F.col("id") % 50 == 0, **options).orderBy("query_id", "rank").collect()]


def test_small_table_is_exact(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    got = rows_of(spark.read.parquet(path))
    r = duckdb.connect().execute(f"select vec_id, embedding from '{path}'").fetchnumpy()
    ids, v = r["vec_id"], np.array([list(x) for x in r["embedding"]], dtype=float)
    want = nn.brute_force(ids, v, np.sort(ids[ids % 50 == 0]), 5)
    assert [g[:3] for g in got] == [tuple(x)[:3] for x in want.itertuples(index=False)]
    assert np.allclose([g[3] for g in got], want["score"], rtol=0, atol=1e-15)


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(nn, "MIN_SEEN", 10)
    monkeypatch.setattr(nn, "CHUNK", 300)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 16)) + rng.normal(size=(10, 16))[rng.integers(0, 10, 4000)]
    d = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(q, x) for q, _, x, _ in rows_of(d)}
    v32 = v.astype(np.float32).astype(float)
    want = nn.brute_force(np.arange(4000), v32, np.arange(0, 4000, 50), 5)
    found = sum((q, x) in got for q, x in zip(want["query_id"], want["vec_id"], strict=True)) / len(want)
    assert found >= 0.9 and len(got) == 400


def test_odd_vectors(spark):
    rng = random.Random(1)
    some = [(k, [rng.random(), rng.random() - 0.5, rng.random(), 1.0], "x", 1) for k in range(0, 60, 10)]
    bad = [(200, None, "x", 1), (250, [], "x", 1), (300, [0.0] * 4, "x", 1), (350, [1.0, None, 1.0, 1.0], "x", 1), (400, [float("nan"), 1.0, 1.0, 1.0], "x", 1), (450, [float("inf"), 1.0, 1.0, 1.0], "x", 1), (None, [1.0] * 4, "x", 1)]
    same = [(k, [2e-200, 0.0, 0.0, 0.0], "x", 1) for k in range(100, 108)] + [(7, [3e200, 0.0, 0.0, 0.0], "x", 1)]
    d = spark.createDataFrame(some + bad + same, "vec_id long, embedding array<double>, score string, rank int")
    got = rows_of(d)
    assert {g[0] for g in got} == {0, 50, 100}
    assert [g[2] for g in got if g[0] == 100] == [7, 101, 102, 103, 104]
    assert nn.nearest(d.limit(0), F.col("id") % 50 == 0).count() == 0
    two = rows_of(d.filter("vec_id in (0, 10)"))
    assert [g[:3] for g in two] == [(0, 1, 10)]


def test_walk_is_in_order():
    rng = np.random.default_rng(2)
    da, db, counts = rng.random(7), rng.random(5), rng.integers(0, 3, (7, 5))
    cells = nn.walk(da, db, counts, np.inf)
    sums = [da[i] + db[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == (counts > 0).sum()


def test_recall_on_a_given_table(spark):
    """Ids divisible by 100 against all rows of sf0.1, a fifth of the vectors probed."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    got = {(r["query_id"], r["vec_id"]) for r in nn.nearest(spark.read.parquet(path), F.col("id") % 100 == 0).collect()}
    r = duckdb.connect().execute(f"select vec_id, embedding from '{path}'").fetchnumpy()
    ids, v = r["vec_id"], np.array([list(x) for x in r["embedding"]], dtype=float)
    want = nn.brute_force(ids, v, ids[ids % 100 == 0], 5)
    assert nn.PROBED <= 0.2 and sum(x in got for x in zip(want["query_id"], want["vec_id"], strict=True)) >= 0.9 * len(want)


def test_scores_do_not_depend_on_the_walk(spark, monkeypatch):
    """With all vectors probed the answer is the exact one, over several chunks and packs."""
    monkeypatch.setattr(nn, "CHUNK", 20)
    monkeypatch.setattr(nn, "PACK", 4)
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(size=(600, 6)), 1)
    v[np.abs(v).sum(axis=1) == 0] = 1.0
    d = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = nn.brute_force(np.arange(600), v, np.arange(0, 600, 50), 5)
    for cells in (1, 7, 64):
        assert [g[:3] for g in rows_of(d, probed=1.0, cells=cells)] == [tuple(x)[:3] for x in want.itertuples(index=False)]
