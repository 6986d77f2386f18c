"""What a Python task holds at once, and results where its input comes in many pieces."""

import re
import tracemalloc
from pathlib import Path
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from tissueflow.operators import vectors


def frame(spark, x, name):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], f"{name}_id long, embedding array<double>").repartition(4)


def test_a_query_is_planned_in_one_row(spark, monkeypatch):
    """However many balls a query visits, its vector is in one row of a round; balls over several buckets and buckets over several packs give brute force."""
    monkeypatch.setattr(vectors, "BUCKET", 40, raising=False)
    monkeypatch.setattr(vectors, "QUERY_PACK", 16)
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(400, 16)), rng.normal(size=(60, 16))
    x[:100] = x[0] + 0.01 * x[:100]  # a ball of more keys than a bucket
    x[100:130] = x[7]
    folder = Path(re.sub("^file:/*", "/", spark.conf.get("spark.checkpoint.dir")))
    old = set(folder.glob("planned-visits-*"))
    report = {}
    got = vectors.top_matches(frame(spark, q, "query"), frame(spark, x, "key"), 5, block=10, report=report)
    got = {(r["query_id"], r["rank"]): (r["key_id"], r["similarity"]) for r in got.collect()}
    s = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 12)
    assert len(got) == 5 * len(q)
    for i in range(len(q)):
        for k, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:5]):
            assert got[i, k + 1][1] == pytest.approx(s[i, j], abs=1e-11)
            assert got[i, k + 1][0] == j or abs(s[i, j] - s[i, got[i, k + 1][0]]) < 1e-11
    rows = [spark.read.parquet(str(p)).count() for p in set(folder.glob("planned-visits-*")) - old]
    assert rows and max(rows) <= len(q) < report["visited"]


def task_of(monkeypatch, build):
    """The function that build hands to Spark's Python tasks, run here on a batch of images: the peak of what it allocates, in bytes, and its rows."""
    held = {}

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **b: (held.setdefault("run", (name, a[0])) if name.startswith("mapIn") else None, self)[1]

    monkeypatch.setattr(vectors, "F", MagicMock())
    build(Frame())
    kind, run = held["run"]
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, 72 * 72 * 3, dtype=np.uint8).tobytes() for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"sample_id": ["a"] * len(images), "cell_idx": range(len(images)), "img": pa.array(images, pa.binary())})
    batch = batch if kind == "mapInArrow" else batch.to_pandas()
    tracemalloc.start()
    n = sum(len(out) if kind == "mapInPandas" else out.num_rows for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, n


@pytest.mark.parametrize("build", [lambda d: vectors.normalised_patches(d, (0.5, 0.4, 0.3), (0.2, 0.2, 0.2)), vectors.patch_statistics], ids=["fn10", "a5"])
def test_a_large_batch_of_images_is_taken_in_slices(monkeypatch, build):
    peak, n = task_of(monkeypatch, build)
    assert n == 1500
    assert peak < 30e6  # all as doubles at once: 83 MB and more


def test_patches_over_several_slices(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (150, 72, 72, 3), dtype=np.uint8)
    rows = [("ab"[k % 2], k, bytearray(v.tobytes())) for k, v in enumerate(x)] + [("a", 900, None), ("none", 901, None)]
    d = spark.createDataFrame(rows, "sample_id string, cell_idx int, img binary").coalesce(1)
    middle = x[:, 12:60, 12:60] / 255.0
    got = {r["cell_idx"]: r for r in vectors.normalised_patches(d, (0.5, 0.4, 0.3), (0.2, 0.3, 0.4)).collect()}
    assert set(got) == set(range(150))
    for k in (0, 63, 64, 149):
        assert got[k]["sample_id"] == "ab"[k % 2]
        assert np.allclose(got[k]["pixels"], ((middle[k] - [0.5, 0.4, 0.3]) / [0.2, 0.3, 0.4]).ravel(), atol=1e-6)
    stats = {r["sample_id"]: r for r in vectors.patch_statistics(d).collect()}
    assert set(stats) == {"a", "b"}
    for i, s in enumerate("ab"):
        one = middle[i::2].reshape(75, -1, 3)
        assert np.allclose(stats[s]["mean"], one.mean(axis=1).mean(axis=0)) and np.allclose(stats[s]["std"], one.std(axis=1, ddof=1).mean(axis=0))


def test_buckets_hold_no_more_than_their_share():
    first, parts = vectors._buckets([30, 30, 50, 250, 1, 99, 1, 0, 100], 100)
    assert first.tolist() == [0, 0, 1, 2, 5, 5, 6, 6, 7]
    assert parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1, 1]
    assert [a.tolist() for a in vectors._buckets([250], 100)] == [[0], [3]]


def bucket_task(monkeypatch, n_keys, n_queries, ties):
    """Peak bytes of a task that matches queries with a bucket of keys, and its matches; ties: keys of equal cosine."""
    held = {}

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **b: (held.setdefault("run", a[0]) if name == "mapInArrow" else None, self)[1]

    rng = np.random.default_rng(3)
    x = np.tile(rng.normal(size=(1, 64)), (n_keys, 1)) if ties else rng.normal(size=(n_keys, 64))
    q = rng.normal(size=(n_queries, 64))
    with monkeypatch.context() as m:
        m.setattr(vectors, "F", MagicMock())
        vectors._bucket_matches(Frame(), Frame(), 8)

    def batches():
        for side, v in ((0, x), (1, q)):
            for at in range(0, len(v), 4096):
                part = v[at : at + 4096]
                n = len(part)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(part.ravel()))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([0] * n, pa.int32()), "pack": pa.array([0] * n, pa.int32()), "side": pa.array([side] * n, pa.int32()),
                    "ball": pa.array([0] * n, pa.int32()), "id": pa.array(np.arange(at, at + n)), "embedding": lists, "least": pa.array([-2.0 if side else None] * n, pa.float64()),
                    "balls": pa.array([[0] if side else None] * n, pa.list_(pa.int32()))})

    tracemalloc.start()
    got = [out for out in held["run"](batches())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, pa.Table.from_batches(got), x, q


@pytest.mark.parametrize("ties", [False, True])
def test_a_full_bucket_is_matched_in_little_memory(monkeypatch, ties):
    peak, got, x, q = bucket_task(monkeypatch, vectors.BUCKET, 300, ties)
    assert got.num_rows == 8 * 300
    ids = got["key_id"].to_numpy().reshape(300, 8)
    if ties:
        assert (ids == np.arange(8)).all()
    else:
        s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
        assert (ids == np.argsort(-s, axis=1)[:, :8]).all()
    assert peak < (60e6 if ties else 25e6)  # by slices of 128 queries: 160 and 42 MB
