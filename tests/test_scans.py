"""Places, running values and ranks over ranges of a table."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissueflow.functions import scalars
from tissueflow.operators import metrics, sampling, scans


def rows_of(n, groups, seed=0):
    rng = random.Random(seed)
    keys = rng.sample(range(10 * n), n)
    return [(rng.choice(groups), k, rng.choice("abcde"), rng.randrange(4)) for k in keys]


@pytest.mark.parametrize(("groups", "partitions"), [(["a", "b", None], 7), (["all"], 16), ([f"g{k}" for k in range(40)], 5)])
def test_places_sums_and_rows_before(spark, groups, partitions):
    rows = rows_of(900, groups)
    d = spark.createDataFrame(rows, "g string, k long, bag string, v long").repartition(6)
    t = scans.ranged(d, ["g"], ["k"], sums={"upto": "v"}, before={"kept": "bag"}, partitions=partitions)
    assert t.select("_range").distinct().count() > 1
    t = scans.placed(t, ["g"], "place")
    t = scans.running(t, ["g"], "v", "upto", "sum")
    t = scans.preceding(t, ["g"], "bag", "kept", "prev")
    got = sorted(map(tuple, scans.plain(t, "upto", "kept").select("g", "k", "place", "sum", "prev").collect()), key=str)
    want, held = [], defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        held[r[0]].append(r)
    for g, rs in held.items():
        want += [(g, r[1], i, sum(x[3] for x in rs[:i]), rs[i - 1][2] if i else None) for i, r in enumerate(rs)]
    assert got == sorted(want, key=str)


def test_one_sample_of_all_rows_is_many_ranges(spark):
    """Batches, pointers and offsets of one sample, in 16 tasks, against a plain count."""
    rows = [("s", k, f"b{k // 7 % 5}") for k in range(5000)]
    d = spark.createDataFrame(rows, "sample_id string, k long, bag string").repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = sampling.batches(d, "k", 64).orderBy("k").collect()
        assert [r["batch"] for r in got] == [k // 64 for k in range(5000)]
        t = scans.ranged(d, ["sample_id"], ["k"])
        assert t.groupBy("_range").count().agg(F.max("count")).first()[0] < 1500
        pointers = sampling.bag_pointers(d, "k", "bag", by=["sample_id"]).orderBy("k").collect()
        assert [r["pointer"] for r in pointers] == [k // 7 for k in range(5000)]
        offsets = {r["bag"]: (r["n"], r["offset"]) for r in sampling.bag_offsets(d, "bag").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    before = 0
    for b in sorted(offsets):
        n = sum(r[2] == b for r in rows)
        assert offsets[b] == (n, before)
        before += n
    shuffled = sampling.batches(d, "k", 64, shuffle=True, seed=3)
    assert shuffled.groupBy("batch").count().filter("count > 64").count() == 0
    again = sampling.batches(d.repartition(3), "k", 64, shuffle=True, seed=3)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, again.collect())) and shuffled.columns == ["sample_id", "k", "bag", "batch"]


def test_ranks_of_nulls_and_ties(spark):
    d = spark.createDataFrame([("g", v) for v in (None, 2.0, 2.0, None, 5.0, 1.0)] + [("h", 3.0), (None, 1.0)], "gene string, y double")
    got = sorted(((r["gene"], r["y"], r["r"]) for r in metrics.average_ranks(d, "y", "r").collect()), key=str)
    assert got == sorted([("g", None, 1.5)] * 2 + [("g", 1.0, 3.0)] + [("g", 2.0, 4.5)] * 2 + [("g", 5.0, 6.0), ("h", 3.0, 1.0), (None, 1.0, 1.0)], key=str)


def test_scores_of_a_gene_with_all_rows(spark):
    """One gene, many ties and zeros, values in many ranges, against numpy."""
    rng = np.random.default_rng(4)
    n = 3000
    y, p = rng.integers(0, 3, n) * rng.random(n).round(2), rng.normal(size=n).round(1)
    truth = spark.createDataFrame([("s", str(k), "g", float(v)) for k, v in enumerate(y) if v], "sample_id string, spot_id string, gene string, value double")
    pred = spark.createDataFrame([("s", str(k), "g", float(v)) for k, v in enumerate(p) if v], "sample_id string, spot_id string, gene string, value double")
    obs = spark.createDataFrame([("s", str(k)) for k in range(n)], "sample_id string, spot_id string")
    r = metrics.sparse_metrics(truth, pred, obs).first()

    def ranks(v):
        values, at, count = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(count) - count + (count + 1) / 2)[at]

    assert r["pcc"] == pytest.approx(np.corrcoef(y, p)[0, 1], abs=1e-12) and r["scc"] == pytest.approx(np.corrcoef(ranks(y), ranks(p))[0, 1], abs=1e-12)
    assert r["mse"] == pytest.approx(((y - p) ** 2).mean(), abs=1e-12)


def test_equal_spot_names_of_two_samples_stay_apart(spark):
    truth = [(s, k, "g", v) for s, vs in (("a", (1.0, 2.0, 4.0)), ("b", (5.0, 0.5, 3.0))) for k, v in zip("xyz", vs, strict=True)]
    pred = [(s, k, "g", v) for s, vs in (("a", (2.0, 1.0, 3.0)), ("b", (1.0, 1.5, 2.5))) for k, v in zip("xyz", vs, strict=True)]
    t, p = (spark.createDataFrame(rows, "sample_id string, spot_id string, gene string, value double") for rows in (truth, pred))
    obs = t.select("sample_id", "spot_id")
    r = metrics.sparse_metrics(t, p, obs).first()
    assert r["pcc"] == pytest.approx(np.corrcoef([x[3] for x in truth], [x[3] for x in pred])[0, 1])
    assert metrics.align(t, p, obs).count() == 6
    assert metrics.sparse_spot_correlation(t, p, obs).count() == 6
    d = t.select("sample_id", "spot_id", F.col("value").alias("count"), F.lit(2.0).alias("mu"), F.lit(1.0).alias("theta"))
    ll = scalars.nb_log_prob_values(np.array([x[3] for x in truth]), np.full(6, 2.0), np.ones(6))
    assert metrics.nb_loss(d).first()[0] == pytest.approx(-ll.mean())


def test_p_values_against_quadrature():
    def tail(r, n):  # the density of r under no correlation, by Gauss-Legendre after r = sin(t)
        t, w = np.polynomial.legendre.leggauss(400)
        a, b = np.arcsin(abs(r)), np.pi / 2
        over = lambda lo, hi: float((w * np.cos((hi - lo) / 2 * t + (hi + lo) / 2) ** (n - 3)).sum() * (hi - lo) / 2)
        return over(a, b) / over(0.0, b)

    r = np.array([0.0, 0.05, -0.3, 0.6, 0.9, -0.99, 0.999])
    for n in (3, 4, 5, 12, 101, 1000, 20000):
        got = scalars.correlation_p_values(r, np.full(len(r), n))
        assert np.allclose(got, [tail(x, n) for x in r], atol=1e-9, rtol=0), n
    assert np.isnan(scalars.correlation_p_values(np.array([0.5]), np.array([2]))).all()
    assert scalars.correlation_p_values(np.array([1.0, -1.0]), np.array([9, 9])).tolist() == [0.0, 0.0]
    x = np.array([0.1, 0.5, 0.9])
    assert np.allclose(scalars.incomplete_beta(x, 2.0, 3.0), 6 * x**2 - 8 * x**3 + 3 * x**4, atol=1e-13)
