"""Nearest spots and nearest vectors against brute force."""

import numpy as np
import pytest

from tissueflow.operators import spatial, vectors


def brute_neighbours(rows, n):
    out = set()
    for s, a, x, y in rows:
        if x is None or y is None:
            continue
        near = sorted((float(np.hypot(x - u, y - v)), b) for t, b, u, v in rows if t == s and b != a and u is not None and v is not None)
        out |= {(s, a, b, k + 1) for k, (_, b) in enumerate(near[:n])}
    return out


def uneven(seed):
    """Two dense places, a thin one, and spots far from all others."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (120, 2)), rng.normal(300, 0.01, (120, 2)), rng.uniform(-1000, 1000, (25, 2)), [[1e6, 1e6], [-1e6, 5.0]]])
    return [("u", f"u{k:03d}", float(a), float(b)) for k, (a, b) in enumerate(x)]


def test_neighbours_without_a_reach(spark):
    rows = uneven(1) + [("few", "f1", 0.0, 0.0), ("few", "f2", 1.0, 0.0), ("few", "f3", 5.0, None), ("one", "o", 2.0, 2.0)]
    rows += [("line", f"l{k:02d}", float(k * k), 7.0) for k in range(30)] + [("same", f"s{k}", 3.0, 3.0) for k in range(9)]
    d = spark.createDataFrame(rows, "sample_id string, spot_id string, x double, y double").repartition(5)
    for n in (6, 1):
        got = {(r["sample_id"], r["src"], r["dst"], r["k"]) for r in spatial.nearest_of_all(d, n).collect()}
        assert got == brute_neighbours(rows, n)


def test_long_edges_go(spark):
    rows = [("a", f"p{i}{j}", float(i), float(j)) for i in range(5) for j in range(5)] + [("a", "far", 100.0, 100.0)]
    d = spark.createDataFrame(rows, "sample_id string, spot_id string, x double, y double")
    got = spatial.nearest_neighbours(d).collect()
    assert got and not any("far" in (r["src"], r["dst"]) for r in got)


def frame(spark, x, name, odd=()):
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + list(odd)
    return spark.createDataFrame(rows, f"{name}_id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_matches_in_balls(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x, q = (np.concatenate([c + spread * rng.normal(size=(n, 16)) for c in centres]) for n in (60, 5))
    x[100:140] = x[7]  # equal keys: ties to the smaller id
    report = {}
    odd = [(9001, [0.0] * 16), (9002, [float("nan")] * 16)]
    got = vectors.top_matches(frame(spark, q, "query", odd), frame(spark, x, "key", odd), 7, block=64, report=report)
    got = {(r["query_id"], r["rank"]): (r["key_id"], r["similarity"]) for r in got.collect()}
    s = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 12)
    assert len(got) == 7 * len(q)
    for i in range(len(q)):
        order = np.lexsort((np.arange(len(x)), -s[i]))[:7]
        for k, j in enumerate(order):
            assert got[i, k + 1][1] == pytest.approx(s[i, j], abs=1e-11)
            assert got[i, k + 1][0] == j or abs(s[i, j] - s[i, got[i, k + 1][0]]) < 1e-11
    assert report["pairs"] == len(q) * 12 or report["pairs"] <= len(q) * 12
    if spread < 1:  # tight balls: a query needs few of them
        assert report["visited"] < 0.4 * report["pairs"]


def test_few_or_no_keys(spark):
    x = np.eye(3)
    assert vectors.top_matches(frame(spark, x, "query"), frame(spark, x[:2], "key"), 5).count() == 6
    none = spark.createDataFrame([], "key_id long, embedding array<double>")
    assert vectors.top_matches(frame(spark, x, "query"), none, 5).count() == 0
