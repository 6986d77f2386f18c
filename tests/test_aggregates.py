"""User aggregates in parts, medians with implicit zeros, profile metadata, the append store and the local regression."""

import pickle
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissueflow.operators import aggregates, genes, pseudobulk
from tissueflow.sources import cell_store, tables

KINDS = {"mean": aggregates.Moments(), "var": aggregates.Moments("variance"), "sd": aggregates.Moments("deviation"), "spread": aggregates.Spread(), "top": aggregates.MeanOfLargest(3), "all": np.median}


def test_aggregates_merge_from_any_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    cells = [(f"c{k}", None if k % 3 == 0 else f"t{k % 3}", k % 2) for k in range(150)]
    values = {(c, g): float(rng.integers(-3, 9)) for c, _, _ in cells for g in "xyz" if rng.random() < 0.5}
    obs = spark.createDataFrame(cells, "cell_id string, kind string, half int").filter("kind is not null")
    e = spark.createDataFrame([(c, g, v) for (c, g), v in values.items()], "cell_id string, gene string, count double")
    want = {}
    for kind in ("t1", "t2"):
        for half in (0, 1):
            for g in "xyz":
                v = np.array([values.get((c, g), 0.0) for c, k, h in cells if (k, h) == (kind, half)])
                if v.any():
                    want[kind, half, g] = (v.mean(), v.var(ddof=1), v.std(ddof=1), v.max() - v.min(), np.sort(v)[-3:].mean(), np.median(v))
    for parts, held in ((1, 50_000), (11, 2)):
        monkeypatch.setattr(aggregates, "HELD", held)
        got = pseudobulk.pseudobulk_with(e.repartition(parts), obs, ["kind", "half"], KINDS, 1, -99).collect()
        assert {(r["kind"], r["half"], r["gene"]) for r in got} == set(want)
        for r in got:
            assert [r[k] for k in KINDS] == pytest.approx(want[r["kind"], r["half"], r["gene"]], abs=1e-9)
    assert pseudobulk.pseudobulk_with(e.filter("count > 99"), obs, ["kind"], KINDS).count() == 0


def test_keys_of_null_stay_apart(spark):
    d = spark.createDataFrame([(None, "x", 2.0, 3), (None, "x", 4.0, 3), ("a", None, 1.0, 1), (None, None, 5.0, 1)], "p string, q string, v double, n int")
    got = {(r["p"], r["q"]): r["m"] for r in aggregates.aggregated(d, ["p", "q"], "n", "v", {"m": aggregates.Moments()}).collect()}
    assert got == {(None, "x"): 2.0, ("a", None): 1.0, (None, None): 5.0}


def test_a_group_of_a_million_cells(spark):
    """Two million counts of one gene: states stay small, and no task gathers the counts."""
    n = 2_000_000
    d = spark.range(n).select(F.lit("g").alias("gene"), (F.col("id") % 1000 + 1).cast("double").alias("v"), F.lit(3_000_000).alias("n"))
    r = aggregates.aggregated(d, ["gene"], "n", "v", {"mean": aggregates.Moments(), "spread": aggregates.Spread(), "top": aggregates.MeanOfLargest(5)}).first()
    assert r["mean"] == pytest.approx(sum(range(1, 1001)) * 2000 / 3_000_000) and r["spread"] == 1000.0 and r["top"] == 1000.0


def test_states_of_a_large_group_are_small():
    rng = np.random.default_rng(0)
    for kind in (aggregates.Moments(), aggregates.Spread(), aggregates.MeanOfLargest(5)):
        state = kind.init()
        for _ in range(50):
            state = kind.update(state, rng.random(10_000))
        assert len(pickle.dumps(kind.zeros(state, 1_000_000))) < 1000


def test_median_with_implicit_zeros(spark):
    cells = [(f"c{k}", "s") for k in range(11)]
    values = {("c%d" % k, "a"): float(k) for k in range(4, 11)} | {("c0", "b"): 3.0} | {("c%d" % k, "c"): 2.5 for k in range(11)}
    e = spark.createDataFrame([(c, g, v) for (c, g), v in values.items()], "cell_id string, gene string, count double")
    obs = spark.createDataFrame(cells, "cell_id string, sample_id string")
    got = {r["gene"]: (r["value"], r["prop"]) for r in pseudobulk.pseudobulk(e, obs, mode="median", min_counts=1, skip_checks=True).collect()}
    want = {g: statistics.median(values.get((c, g), 0.0) for c, _ in cells) for g in "abc"}
    assert got == {"a": (want["a"], 7 / 11), "c": (want["c"], 1.0)} and want["b"] == 0


def test_profiles_get_constant_columns(spark):
    obs = spark.createDataFrame([("a", "s1", "x", "p", None), ("b", "s1", "x", "q", None), ("c", "s2", None, "p", 4)], "cell_id string, sample_id string, tissue string, place string, age int")
    profiles = spark.createDataFrame([("s1", "g", 1.0), ("s2", "g", 2.0), ("s3", "g", 0.0)], "sample_id string, gene string, value double")
    d = pseudobulk.with_constant_columns(profiles, obs, ["sample_id"])
    assert d.columns == ["sample_id", "gene", "value", "tissue", "age"]
    assert {tuple(r) for r in d.collect()} == {("s1", "g", 1.0, "x", None), ("s2", "g", 2.0, None, 4), ("s3", "g", 0.0, None, None)}


def cells(spark, ids, label=1):
    return spark.createDataFrame([(f"S{k % 2}", k, label) for k in ids], "sample_id string, cell_idx long, label int")


class Killed(Exception):
    pass


def dying(spark, good):
    yield "b0", good
    raise Killed


def test_a_load_that_dies_takes_no_effect_and_is_retried(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no load"):
        cell_store.read(spark, path)
    cell_store.append(spark, path, "old", {"b0": cells(spark, range(5))})
    with pytest.raises(Killed):
        cell_store.append(spark, path, "new", dying(spark, cells(spark, range(10, 20))))
    assert sorted(r["cell_idx"] for r in cell_store.read(spark, path).collect()) == list(range(5))
    staged = list((tmp_path / "store/batches/new/b0").rglob("*.parquet"))
    half = tmp_path / "store/batches/new/b1"  # what a job killed while it wrote leaves: files, but no mark of success
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"not whole")
    again = {"b0": cells(spark, range(90, 99)), "b1": cells(spark, range(20, 25))}
    assert cell_store.append(spark, path, "new", again)
    assert list((tmp_path / "store/batches/new/b0").rglob("*.parquet")) == staged  # kept from the first attempt
    want = [*range(5), *range(10, 25)]
    assert sorted(r["cell_idx"] for r in cell_store.read(spark, path).collect()) == want
    assert not cell_store.append(spark, path, "new", again)  # done before
    assert sorted(r["cell_idx"] for r in cell_store.read(spark, path).collect()) == want


def test_loads_replace_add_and_exclude_each_other(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    tables.append_cells([cells(spark, range(3))], path, "draft")
    tables.append_cells([cells(spark, range(4), 2), cells(spark, range(4, 6), 2)], path, "first")
    tables.append_cells([cells(spark, range(6, 8)).withColumn("more", F.lit("x"))], path, "second", replace=False)
    got = cell_store.read(spark, path)
    assert sorted((r["cell_idx"], r["label"], r["more"]) for r in got.collect() if r["more"]) == [(6, 1, "x"), (7, 1, "x")] and got.count() == 8
    monkeypatch.setattr(cell_store, "_newest", lambda files: (2, {"loads": ["draft", "first"], "batches": []}))  # another writer was faster
    with pytest.raises(RuntimeError, match="another load"):
        cell_store.append(spark, path, "third", {"b": cells(spark, range(9))})
    monkeypatch.undo()
    assert cell_store.swept(spark, path) == 2 and cell_store.read(spark, path).count() == 8
    with pytest.raises(ValueError, match="not a name"):
        cell_store.append(spark, path, "../x", {})


def test_local_regression_blends_fits_at_vertices():
    rng = np.random.default_rng(7)
    x = np.sort(rng.normal(size=400))
    y = np.sin(2 * x) + 0.1 * rng.normal(size=400)
    at = genes._vertices(x, int(400 * 0.3 * 0.2))
    got = genes._loess(np.append(x, []), y, 0.3)
    for v in at[1:-1]:  # at a vertex the curve is the direct fit

        def direct(v=v):
            d = np.abs(x - v)
            near = np.argsort(d, kind="stable")[:120]
            w = (1 - np.minimum(d[near] / d[near].max(), 1) ** 3) ** 3
            return np.polyfit(x[near] - v, y[near], 2, w=np.sqrt(w))

        value, slope = genes._local_fit(x, y, v, 120)
        assert value == pytest.approx(direct()[2], abs=1e-6) and slope == pytest.approx(direct()[1], abs=1e-6)
    assert np.abs(got - np.sin(2 * x)).max() < 0.35
    ties = np.repeat([0.0, 1.0, 2.0, 3.0], 25)
    assert np.isfinite(genes._loess(ties, ties**2, 0.5)).all() and np.isfinite(genes._loess(np.zeros(9), np.ones(9), 0.3)).all()
    assert genes._loess(np.array([1.0]), np.array([2.0]), 0.3) == pytest.approx([2.0])


def test_local_regression_is_linear_in_genes():
    rng = np.random.default_rng(7)
    took = []
    for n in (20_000, 200_000):
        x = rng.normal(size=n)
        start = time.process_time()
        genes._loess(x, x * x + rng.normal(size=n), 0.3)
        took.append(time.process_time() - start)
    assert len(genes._vertices(np.sort(x), int(n * 0.06))) < 40 and took[1] < 40 * max(took[0], 0.02)
