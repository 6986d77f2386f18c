"""Operator 13 against scores of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tissueflow.llm import hardneg

COLUMNS = "vec_id long, embedding array<float>, label int, score string, block int"


def brute(rows, positives=5, negatives=5):
    seen = {}
    size = [len(r[1]) for r in rows if r[1]]
    size = max(set(size), key=lambda n: (size.count(n), -n)) if size else 0
    for i, v, label in rows:
        if i is None or label is None or not v or len(v) != size or any(x is None or not np.isfinite(x) for x in v):
            continue
        got = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        seen[i] = min(seen.get(i, got), got)
    out = []
    for a, (label, v) in seen.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in seen.items() if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if seen[i][0] == label][:positives]:
            fit = [i for i in best if seen[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:negatives])]
    return sorted(out)


def found(spark, rows, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hardneg.hard_negatives(d, F.col("id") % 100 == 0, label, **more).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def vectors(n, dims, labels, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in np.float32(rng.normal(size=dims))], int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("dims", [3, 19])
def test_random_vectors(spark, dims):
    rows = vectors(900, dims, 3)
    assert found(spark, rows, block=100) == brute(rows)


def test_copies_ties_and_a_hot_label(spark):
    rows = vectors(400, 4, 10, 2)
    one = rows[5][1]
    rows += [(k, one, k % 2) for k in range(1000, 1600)]
    rows += [(k, [0.25 * x for x in random.Random(k).sample([1.0, 2.0, -1.0, 0.0], 4)], 3) for k in range(2000, 2600)]
    assert found(spark, rows, block=64) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(60, 4, 2, 3)
    rows += [(100, [1.0, 0.0, 0.0, 0.0], 0), (200, [0.0, 0.0, 0.0, 0.0], 1), (300, [-1.0, -1.0, -1.0, -1.0], 5), (400, None, 1), (500, [1.0, float("nan"), 0.0, 0.0], 1)]
    rows += [(600, [1.0, None, 0.0, 0.0], 1), (700, [1.0, 2.0], 1), (800, [], 1), (900, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1), (1000, [float("inf"), 1.0, 1.0, 1.0], 1)]
    rows += [(100, [1.0, 0.0, 0.0, 0.0], 0), (200, [3.0, 1.0, 0.0, 0.0], 1), (17, rows[17][1], 9)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] == found(spark, [(1, [1.0], 1)]) == found(spark, [(100, [1.0], 1)]) == found(spark, [(1, None, 1)])


def test_index_leaves_nothing_out():
    """Every pair above its threshold, at thresholds that omit and prune much, and with none."""
    rng = np.random.default_rng(0)
    x, q = np.floor(256 * rng.normal(size=(500, 40)) * np.linspace(0.2, 2, 40)), np.floor(256 * rng.normal(size=(30, 40)) * np.linspace(0.2, 2, 40))
    norm, exact = np.sqrt((q * q).sum(axis=1)), q @ x.T
    for share in (None, 0.05, 0.2, 0.4, 0.7):
        most = np.sqrt((x * x).sum(axis=1)).max()
        t = np.full(30, -np.inf) if share is None else share * most * norm
        for live in (0.0, 0.1, 1.0):
            index = hardneg.Index(x, -1.0 if share is None else share * most)
            a, b, score = index.join(q, t, live)
            want = np.argwhere(exact >= t[:, None])
            assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(map(tuple, want.tolist())) and (score == exact[a, b]).all()
        assert share is None or share < 0.2 or index.cut.max() > 0


def test_nothing_is_broadcast_by_way_of_the_driver(spark):
    """Packs times blocks grow faster than the input: no plan that runs may send them, or what grows with the anchors, to the driver."""
    rows = vectors(900, 8, 3, 4)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    ran = lambda: [(bus.waitUntilEmpty(), store.executionsList())[1].apply(k) for k in range(store.executionsList().size())]
    old = {e.executionId() for e in ran()}
    assert found(spark, rows, block=100) == brute(rows)
    plans = [e.physicalPlanDescription() for e in ran() if e.executionId() not in old]
    assert sum("MapInArrow" in p for p in plans) > 1
    assert [p for p in plans if "Broadcast" in p] == []


def test_packs_follow_their_block_over_batches():
    """Packs meet the last block before them; those of a block without rows meet none; of rows with one id the first counts."""
    kind = pa.schema([("number", pa.int32()), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.float64())), ("q_anchor", pa.list_(pa.int64()))])
    block = lambda n, ids, v: {"number": n, "ids": ids, "vectors": v, "q_anchor": None}
    pack = lambda n, a: {"number": n, "ids": None, "vectors": None, "q_anchor": a}
    batches = [[pack(0, [100]), block(1, [1, 1, 2], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], [], [pack(1, [200]), pack(1, [300, 400]), pack(2, [500]), block(3, [7], [8.0, 9.0]), pack(3, [600])]]
    got = [(ids.tolist(), x.tolist(), row["q_anchor"].as_py()) for ids, x, row in hardneg._met(iter(pa.RecordBatch.from_pylist(b, kind) for b in batches))]
    one = ([1, 2], [[1.0, 2.0], [5.0, 6.0]])
    assert got == [(*one, [200]), (*one, [300, 400]), ([7], [[8.0, 9.0]], [600])]


def test_a_block_without_rows(spark):
    """Blocks are counted by a label's rows; where many of them have one id, some blocks stay empty."""
    rows = vectors(300, 4, 2, 5) + [(1000, [float(k), 1.0, 0.0, 0.0], 4) for k in range(90)] + [(k, [1.0, 1.0, float(k % 3), 0.0], 4) for k in (401, 402)]
    assert found(spark, rows, block=20) == brute(rows)
