"""Hand-computed cases, and numpy for what SQL cannot express."""

import math
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissueflow.functions import scalars
from tissueflow.operators import counts, genes, metrics, pseudobulk, qc, samples, sampling, spatial, vectors
from tissueflow.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def spots_of(spark, rows):
    return frame(spark, [("s", p, f"p{p}", float(x), float(y)) for p, x, y in rows], "sample_id string, spot_pos int, spot_id string, x double, y double")


def cells_of(spark, rows):
    return frame(spark, [("s", k, x, y) for k, (x, y) in enumerate(rows)], "sample_id string, cell_idx long, x double, y double")


def test_quality_is_strict(spark):
    t = frame(spark, [("s", "a", "g", 20.0), ("s", "a", "g", 20.1), ("s", "UNASSIGNED", "g", 40.0), ("s", None, "g", 40.0), ("s", "a", "g", None)], "sample_id string, cell_id string, feature_name string, qv double")
    assert [r["qv"] for r in counts.quality_transcripts(t).collect()] == [20.1]


def test_radius_join(spark):
    s = spots_of(spark, [(0, 0, 0), (1, 100, 0)])
    join = lambda cells, r: [x["spot_id"] for x in spatial.radius_join(cells_of(spark, cells), s, r).orderBy("cell_idx").collect()]
    assert join([(55.0, 0.0)], 60) == ["p1"]
    assert join([(3.0, 4.0), (3.0, 4.001)], 5) == ["p0", None]
    assert join([(500.0, 0.0), (None, 0.0)], 60) == [None, None]
    rng = np.random.default_rng(0)
    some = rng.integers(-50, 150, (300, 2)).astype(float).tolist()
    where = rng.integers(-50, 150, (40, 2)).tolist()
    got = [x["spot_id"] for x in spatial.radius_join(cells_of(spark, some), spots_of(spark, [(k, *p) for k, p in enumerate(where)]), 13.5).orderBy("cell_idx").collect()]
    for (x, y), g in zip(some, got, strict=True):
        near = [k for k, (a, b) in enumerate(where) if (a - x) ** 2 + (b - y) ** 2 <= 13.5**2]
        assert g == (f"p{max(near)}" if near else None)


def test_counts_align(spark):
    cells = frame(spark, [("s", "a", 1.9, 2.0), ("s", "b", 3.0, -4.9)], "sample_id string, cell_id string, x double, y double")
    c = frame(spark, [("s", "a", "g", 2.0), ("s", "z", "g", 1.0)], "sample_id string, cell_id string, gene string, count double")
    assert [r["cell_id"] for r in counts.align_counts(c, cells).collect()] == ["a"]
    assert [r["cell_id"] for r in counts.cells_without_transcripts(cells, c).collect()] == ["b"]
    assert [(r["x"], r["y"]) for r in counts.attach_centroids(cells.select("sample_id", "cell_id"), cells).orderBy("cell_id").collect()] == [(1, 2), (3, -4)]


def test_size_factors_and_scaling(spark):
    obs = frame(spark, [("s", k) for k in "abc"], "sample_id string, spot_id string")
    e = frame(spark, [("s", "a", "g", 2.0), ("s", "b", "g", 4.0), ("s", "c", "g", 6.0)], "sample_id string, spot_id string, gene string, count double")
    assert [r["size_factor"] for r in qc.size_factors(e, obs).orderBy("spot_id").collect()] == [0.5, 1.0, 1.5]
    d = frame(spark, [("s", str(k), "g", float(v)) for k, v in enumerate((0, 0, 1, 5, 10))] + [("s", str(k), "flat", 3.0) for k in range(2)], "sample_id string, spot_id string, gene string, value double")
    got = qc.robust_scale(d).orderBy("gene", "value").collect()
    assert [round(r["value"], 9) for r in got if r["gene"] == "g"] == [0, 0, round(1 / 9, 9), round(5 / 9, 9), round(10 / 9, 9)]
    assert [r["value"] for r in got if r["gene"] == "flat"] == [3.0, 3.0] and qc.robust_scale(d, "true") is d


def test_check_counts(spark):
    make = lambda v: frame(spark, [(float(x),) for x in v], "count double")
    qc.check_counts(make([1, 2.5, 0.5]))
    qc.check_counts(make([]))
    qc.check_counts(make([1, -2.5]), skip=True)
    for bad, mode in (([1, float("nan")], "sum"), ([1, float("inf")], "mean"), ([1, -1], "mean"), ([1, 0.5], "sum")):
        with pytest.raises(ValueError):
            qc.check_counts(make(bad), mode)
    qc.check_counts(make([1, 0.5]), "mean")


def test_ranks_and_metrics(spark):
    d = frame(spark, [("g", str(k), float(v)) for k, v in enumerate((1, 2, 2, 5))], "gene string, spot_id string, y double")
    assert [r["r"] for r in metrics.average_ranks(d, "y", "r").orderBy("spot_id").collect()] == [1, 2.5, 2.5, 4]
    rows = [("flat", str(k), 1.0, float(k)) for k in range(3)] + [("g", str(k), float(v), float(w)) for k, (v, w) in enumerate(zip((1, 2, 2, 5), (2, 1, 4, 4), strict=True))]
    m = {r["gene"]: r for r in metrics.regression_metrics(frame(spark, rows, "gene string, spot_id string, y double, p double")).collect()}
    assert m["flat"]["pcc"] is None and m["flat"]["scc"] is None and m["flat"]["mse"] == pytest.approx(2 / 3)
    assert m["g"]["pcc"] == pytest.approx(np.corrcoef((1, 2, 2, 5), (2, 1, 4, 4))[0, 1]) and m["g"]["scc"] == pytest.approx(np.corrcoef((1, 2.5, 2.5, 4), (2, 1, 3.5, 3.5))[0, 1])
    w = frame(spark, [("t", 0.5, 0.4, 1.0)], "tag string, `pcc/a/b` double, `scc/a/b` double, `mse/a/b` double")
    assert [tuple(r) for r in metrics.long_metrics(w).collect()] == [("t", "a/b", 0.5, 0.4, 1.0)]


def test_rand_index(spark):
    make = lambda rows: frame(spark, rows, "a string, b string")
    assert metrics.adjusted_rand_index(make([("1", "x"), ("1", "x"), ("2", "y"), ("undetermined", "x")])).first()[0] == 1.0
    assert metrics.adjusted_rand_index(make([("1", "x"), ("1", "x")])).first()[0] == 1.0
    assert metrics.adjusted_rand_index(make([("1", "x"), ("1", "y"), ("2", "x"), ("2", "y")])).first()[0] == pytest.approx(-0.5)


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.stable_int(F.lit("AAAC-1_TENX39")).alias("k"), scalars.parse_tag(F.lit("a=1;b=HVG:1000")).alias("m"), scalars.gene_spec(F.lit("HVG:1000")).alias("s"), scalars.gene_spec(F.lit("all")).alias("n"),
        scalars.train_slide(F.array(F.lit("x"), F.lit("y")), F.lit(None)).alias("t"), scalars.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("u"), scalars.class_name(F.lit(9)).alias("c"), scalars.class_label(F.lit("Dead")).alias("l"),
    ).first()
    assert r["k"] == 9314199 and r["m"] == {"a": "1", "b": "HVG:1000"} and tuple(r["s"]) == ("HVG", 1000) and tuple(r["n"]) == ("all", None)
    assert r["t"] == "x" and r["u"] == [None, None] and r["c"] is None and r["l"] == 1
    d = frame(spark, [("b",), (None,), ("a",), ("b",)], "c string")
    assert sorted((x["c"] or "", x["k"]) for x in scalars.category_codes(d, "c", "k").collect()) == [("", -1), ("a", 0), ("b", 1), ("b", 1)]


def test_nb_log_prob():
    x = np.array([0.0, 1, 5, 40])
    got = scalars.nb_log_prob_values(x, np.full(4, 3.0), np.full(4, 0.7))
    want = [math.lgamma(k + 0.7) - math.lgamma(0.7) - math.lgamma(k + 1) + 0.7 * math.log(0.7 / 3.7) + k * math.log(3 / 3.7) for k in x]
    assert np.allclose(got, want, atol=1e-6)
    assert np.allclose(scalars._lgamma(np.array([0.05, 0.5, 1, 2, 7.9, 8, 100])), [math.lgamma(v) for v in (0.05, 0.5, 1, 2, 7.9, 8, 100)], atol=1e-11)
    z = scalars.zinb_log_prob_values(np.arange(400.0), np.full(400, 3.0), np.full(400, 0.7), np.full(400, -0.4))
    assert np.exp(z).sum() == pytest.approx(1, abs=1e-5)


def test_pseudobulk_gate(spark):
    obs = frame(spark, [(f"c{k}", "s", "a" if k < 9 else "b") for k in range(19)], "cell_id string, sample_id string, cell_type string")
    e = frame(spark, [(f"c{k}", "g", 200.0) for k in range(19)], "cell_id string, gene string, count double")
    got = pseudobulk.pseudobulk(e, obs, groups="cell_type").collect()
    assert [(r["cell_type"], r["value"], r["n_cells"], r["prop"]) for r in got] == [("b", 2000.0, 10, 1.0)]
    assert pseudobulk.constant_columns(obs.withColumn("k", F.when(F.col("cell_id") == "c1", "x")), ["cell_type"], ["sample_id", "k"]) == ["sample_id"]
    assert pseudobulk.pseudobulk(e, obs, groups=["cell_type", "sample_id"]).columns[:2] == ["sample_id", "cell_type_sample_id"]


def test_lattice(spark):
    s = frame(spark, [("s", f"p{k}", r, c) for k, (r, c) in enumerate(((0, 0), (0, 2), (1, 1), (5, 5)))], "sample_id string, spot_id string, array_row int, array_col int")
    assert sorted((r["src"], r["dst"]) for r in spatial.hex_neighbours(s).collect()) == [(f"p{a}", f"p{b}") for a in range(3) for b in range(3) if a != b]


def test_unique_names(spark):
    d = frame(spark, [("A", 0), ("A", 1), ("A-1", 2), ("A", 3), ("B", 4)], "gene string, pos int")
    assert [r["unique"] for r in genes.unique_names(d).orderBy("pos").collect()] == ["A", "A-2", "A-1", "A-3", "B"]


def test_samples(spark):
    s = frame(spark, [("a",), ("b",)], "id string")
    assert [r["id"] for r in samples.pick_samples(s, ["b", "a"]).collect()] == ["b", "a"]
    with pytest.raises(KeyError):
        samples.pick_samples(s, ["c"])
    with pytest.raises(ValueError):
        samples.common_radius(frame(spark, [(55.0,), (57.0,)], "spot_diameter double"))


def test_highly_variable_against_dense(spark):
    rng = np.random.default_rng(3)
    x = rng.negative_binomial(2, 0.3, (120, 60)) * (rng.random((120, 60)) < rng.random(60))
    x[:20, 5] += 30
    e = frame(spark, [(str(i), f"g{j:02d}", float(x[i, j])) for i in range(120) for j in range(60) if x[i, j]], "spot_id string, gene string, count double")
    got = genes.highly_variable(e, spark.range(120), 60).orderBy("rank").collect()
    mean, var = x.mean(0), x.var(0, ddof=1)
    use = np.flatnonzero(var > 0)
    sd = np.sqrt(10 ** genes._loess(np.log10(mean[use]), np.log10(var[use]), 0.3))
    clip = np.minimum(x[:, use], sd * np.sqrt(120) + mean[use])
    score = (120 * mean[use] ** 2 + (clip**2).sum(0) - 2 * mean[use] * clip.sum(0)) / (119 * sd**2)
    want = {f"g{j:02d}": s for j, s in zip(use, score, strict=True)}
    assert len(got) == len(want) and all(r["score"] == pytest.approx(want[r["gene"]], rel=1e-6) for r in got)
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def test_loess_is_exact_on_a_parabola():
    x = np.linspace(-1, 2, 50)
    assert np.allclose(genes._loess(x, 1 + 2 * x - 3 * x * x, 0.3), 1 + 2 * x - 3 * x * x)


def test_network(spark):
    rng = np.random.default_rng(1)
    layers = [(rng.normal(size=(5, 4)), rng.normal(size=5)), (rng.normal(size=(2, 5)), rng.normal(size=2))]
    v = rng.normal(size=(20, 4))
    d = frame(spark, [(k, x.tolist()) for k, x in enumerate(v)], "cell_idx long, embedding array<double>")
    hidden = v @ layers[0][0].T + layers[0][1]
    out = np.where(hidden > 0, hidden, 0.01 * hidden) @ layers[1][0].T + layers[1][1]
    want = {"identity": out, "relu": np.maximum(out, 0), "sigmoid": 1 / (1 + np.exp(-out)), "softmax": np.exp(out) / np.exp(out).sum(1, keepdims=True), "softplus": np.where(20 * out > 20, out, np.log1p(np.exp(np.minimum(20 * out, 20))) / 20)}
    for name, w in want.items():
        got = [r["prediction"] for r in vectors.predict_cells(d, layers, name).orderBy("cell_idx").collect()]
        assert np.allclose(got, w)


def test_matches(spark):
    q = frame(spark, [(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    k = frame(spark, [(1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "key_id long, embedding array<double>")
    m = vectors.top_matches(q, k, 2)
    assert [r["key_id"] for r in m.orderBy("rank").collect()] == [1, 2]
    exact = vectors.match_weights(m, frame(spark, [(1, [2.0, 0.0])], "query_id long, embedding array<double>"), k)
    assert {r["key_id"]: r["weight"] for r in exact.collect()} == {1: 1.0, 2: 0.0}


def test_patches(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (4, 72, 72, 3)).astype(np.uint8)
    d = frame(spark, [("s", k, bytearray(p.tobytes())) for k, p in enumerate(x)] + [("s", 9, None)], "sample_id string, cell_idx long, img binary")
    mid = x[:, 12:60, 12:60].reshape(4, -1, 3) / 255
    r = vectors.patch_statistics(d).first()
    assert np.allclose(r["mean"], mid.mean(1).mean(0)) and np.allclose(r["std"], mid.std(1, ddof=1).mean(0))
    got = vectors.normalised_patches(d, r["mean"], r["std"]).orderBy("cell_idx").collect()
    assert len(got) == 4 and np.allclose(got[0]["pixels"], ((mid[0] - r["mean"]) / r["std"]).ravel(), atol=1e-5)


def test_splits_do_not_depend_on_partitions(spark):
    d = spark.range(101).withColumnRenamed("id", "k")
    a, b = ({r["k"] for r in sampling.split(x, "k", 0.8, 3).filter("train").collect()} for x in (d, d.repartition(9)))
    assert a == b and len(a) == 101 - math.floor(0.2 * 101 + 1e-9) and a != {r["k"] for r in sampling.split(d, "k", 0.8, 4).filter("train").collect()}
    p = sampling.draw_pseudo_spots(spark.range(7).withColumnRenamed("id", "cell_idx"), 30, 5)
    assert p.count() == 150 and {r["cell_idx"] for r in p.collect()} <= set(range(7))


def test_medoids(spark):
    rows = [(f"t{k}", f"g{j}", float(10 * (k // 3) + (k % 3 == 1) * 0.1 * j)) for k in range(9) for j in range(3)]
    got = vectors.medoid_types(frame(spark, rows, "cell_type string, gene string, value double"), 3)
    assert [int(t[1]) // 3 for t in got] == [0, 1, 2]


def test_runs(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"r{k}").mkdir()
        (tmp_path / f"r{k}" / "metrics.json").write_text(f'{{"pcc/a": {k}}}\n')
        (tmp_path / f"r{k}" / "overrides.txt").write_text(f"- a.b.lr={k}\nname=x{k}\n")
    got = tables.load_runs(spark, str(tmp_path)).orderBy("run").collect()
    assert [(r["pcc/a"], r["lr"], r["name"]) for r in got] == [(0, 0.0, "x0"), (1, 1.0, "x1")]


def test_runs_with_hydra_folders(spark, tmp_path):
    """Run folders as a training tool leaves them: overrides in a folder whose name begins with a dot."""
    for k in range(2):
        (tmp_path / f"r{k}" / ".hydra").mkdir(parents=True)
        (tmp_path / f"r{k}" / "metrics.json").write_text('{"pcc": 0.%d}\n' % (k + 1))
        (tmp_path / f"r{k}" / ".hydra" / "overrides.yaml").write_text(f"- model.lr=0.{k + 3}\n- data.genes=HVG:{k}\n")
    got = [tuple(r) for r in tables.load_runs(spark, str(tmp_path)).orderBy("run").select("run", "pcc", "lr", "genes").collect()]
    assert got == [("r0", 0.1, 0.3, "HVG:0"), ("r1", 0.2, 0.4, "HVG:1")]
    with pytest.raises(ValueError):
        tables.load_runs(spark, str(tmp_path / "none"))


def test_scaling_without_zero_rows(spark):
    """Absent rows count as zeros: the same ranges as with every zero written out."""
    rng = random.Random(2)
    obs = spark.createDataFrame([(s, f"{s}{k}") for s in "ab" for k in range(20)], "sample_id string, spot_id string")
    dense = [(s, f"{s}{k}", g, rng.random() if rng.random() < p else 0.0) for s in "ab" for k in range(20) for g, p in (("g", 0.3), ("h", 0.02), ("i", 1.0))]
    every = spark.createDataFrame(dense, "sample_id string, spot_id string, gene string, value double")
    for mode in ("global_scaling", "slide_scaling"):
        want = {tuple(r) for r in qc.robust_scale(every, mode).filter("value <> 0").select("sample_id", "spot_id", "gene", "value").collect()}
        got = {tuple(r) for r in qc.robust_scale(every.filter("value <> 0"), mode, obs=obs).select("sample_id", "spot_id", "gene", "value").collect()}
        assert got == want


def test_each_plan_module_can_be_imported_first():
    for name in ("matrix", "chosen", "workloads", "registry"):
        subprocess.run([sys.executable, "-c", f"import tissueflow.plans.{name} as m; from tissueflow.plans import registry; assert len(registry.QUERIES) > 100"], cwd=Path(__file__).parents[1], check=True)


def test_sparse_metrics_are_those_of_the_dense_table(spark):
    rng = np.random.default_rng(5)
    truth, pred = ([(f"s{s}", f"g{g}", float(rng.integers(-2, 4))) for s in range(12) for g in range(9) if rng.random() < 0.4] for _ in range(2))
    truth += [("s0", "flat", 2.0), ("elsewhere", "g0", 9.0), ("elsewhere", "away", 1.0)]
    pred += [("s3", "flat", 0.0), ("s1", "away", 0.0), ("s2", "unmeasured", 1.0)]
    truth, pred = (frame(spark, rows, "spot_id string, gene string, value double") for rows in (truth, pred))
    obs = frame(spark, [(f"s{s}",) for s in range(14)], "spot_id string")
    for by in ("gene", "spot_id"):
        want = {r[by]: r for r in metrics.regression_metrics(metrics.align(truth, pred, obs), by).collect()}
        got = {r[by]: r for r in metrics.sparse_metrics(truth, pred, obs, by).collect()}
        assert set(got) == set(want)
        for k, r in want.items():
            for m in ("pcc", "scc", "mse"):
                assert got[k][m] == (None if r[m] is None else pytest.approx(r[m], abs=1e-12)), (k, m)


def test_pseudobulk_checks_and_keeps_empty_profiles(spark):
    obs = frame(spark, [("c1", "s", "a"), ("c2", "s", "b"), ("c3", "t", "a")], "cell_id string, sample_id string, cell_type string")
    e = frame(spark, [("c1", "g", 3.0), ("c2", "h", 1.0), ("c3", "g", 2.0)], "cell_id string, gene string, count double")
    make = lambda e, **o: pseudobulk.pseudobulk(e, obs, groups="cell_type", min_cells=1, min_counts=2, **o)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in make(e, remove_empty=False).collect()}
    assert len(got) == 8
    assert got["s", "a", "g"] == (3.0, 1.0, 1, 3.0)
    assert got["s", "b", "h"] == (0.0, 0.0, 1, 1.0)
    assert got["t", "b", "g"] == (0.0, 0.0, None, None)
    assert {tuple(r)[:3] for r in make(e).collect()} == {("s", "a", "g"), ("t", "a", "g")}
    for bad in (-1.0, 0.5, float("nan")):
        odd = e.union(frame(spark, [("c1", "h", bad)], e.schema))
        with pytest.raises(ValueError, match="counts"):
            make(odd)
    make(e.union(frame(spark, [("c1", "h", 0.5)], e.schema)), mode="mean")


def test_common_variable_genes_by_median_rank(spark):
    rng = np.random.default_rng(11)
    obs = [(f"c{c}", f"b{c % 3}") for c in range(90)]
    e = [(c, b, f"g{g}", float(v)) for c, b in obs for g in range(30) if (v := rng.negative_binomial(1 + g % 4, 0.2 + g / 60)) > 0]
    obs, e = frame(spark, obs, "cell_id string, sample_id string"), frame(spark, e, "cell_id string, sample_id string, gene string, count double")
    ranks = {}
    for b in ("b0", "b1", "b2"):
        one = genes.highly_variable(e.filter(F.col("sample_id") == b), obs.filter(F.col("sample_id") == b), 10)
        for r in one.collect():
            ranks.setdefault(r["gene"], []).append(r["rank"])
    want = sorted((float(np.median(v)), -len(v), g) for g, v in ranks.items())[:10]
    assert [(r["median_rank"], -r["n_batches"], r["gene"]) for r in genes.common_highly_variable(e, obs, 10).collect()] == want


def test_clusters_of_embeddings(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(20, 6)) + 20 * np.eye(6)[k] for k in range(3)])
    got = vectors.cluster_embeddings(frame(spark, [(k, v.tolist()) for k, v in enumerate(x)], "cell_idx long, embedding array<double>"), k=3, dims=2).orderBy("cell_idx").collect()
    of = np.array([r["cluster"] for r in got])
    assert [len(set(of[a : a + 20])) for a in (0, 20, 40)] == [1, 1, 1]
    assert len(set(of)) == 3
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    flat = x @ axes.T
    centres = np.stack([flat[of == k].mean(0) for k in range(3)])
    want = np.linalg.norm(flat[:, None] - centres, axis=2)
    assert np.allclose(np.array([r["distances"] for r in got]), want, atol=1e-6)
