"""Operator 13, hard negatives by threshold joins in the manner of L2AP.

Every score is a threshold join of anchors with all rows. Rows lie in blocks by a hash of their id. In a block, dimensions have one
order, and a row is indexed only from the step of dimensions at which the norm of those before, times the largest norm of the
anchors, reaches the threshold: a row that shares only the dimensions left out cannot reach it. Partial scores are
accumulated over the postings of each step, from the last on; a pair whose partial score and remaining norms (Cauchy-Schwarz)
stay below its threshold goes. What is left is scored exactly, in whole numbers.

First come positives: thresholds start at a share of an anchor's norm times the largest norm, and are lowered for anchors that have found
fewer than wanted, round by round, at last to none. Then negatives: for each positive score p there is a window [LEAST * p, p]; its
threshold starts near p and is lowered, down to LEAST * p, for windows that are not full. A block hands on the best few of each anchor
or window only, so the rows moved do not grow with how many reach a threshold.

Positives meet only blocks of their own label. Blocks are split by size, whatever the label's share.

Defined results: rows with a null id, label or vector, an empty vector, one of another length than most, or a null or non-finite component take no
part; of rows with one id, the first by label and vector counts; an empty table, or one without anchors, gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

POSITIVES = NEGATIVES = 5
#: The window of negative scores below a positive score: at least LEAST hundredths of it.
LEAST = 80
#: Thresholds of the rounds: shares of the largest possible score for positives (None: no threshold), hundredths of the positive score for negatives.
POSITIVE_ROUNDS: tuple[float | None, ...] = (0.9, 0.6, 0.4, 0.3, 0.2, None)
NEGATIVE_ROUNDS = (97, 90, LEAST)
BLOCK, PACK, STEP = 4096, 256, 8
_NONE = -(1 << 62)


def prepared(vectors: DataFrame, label: Column, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, label and v, the whole-number components of the vectors that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    d = d.filter("id is not null and label is not null and size(v) > 0").filter(finite)
    lengths = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return d.filter(F.size("v") == (lengths[0]["n"] if lengths else 0)).select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _order(rows: DataFrame) -> tuple[list[int], float]:
    """Dimensions by ascending energy, as the last are accumulated first, and the largest norm."""
    energy = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x") * F.col("x")).alias("e")).orderBy("e", "k").collect()
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    return [r["k"] for r in energy], float(np.sqrt(most)) if most is not None else 0.0


def _blocks(rows: DataFrame, order: Sequence[str], block: int) -> tuple[DataFrame, dict[int, range]]:
    """number, ids, vectors (one array, dimensions in order): rows of a label in blocks of some block rows; and the numbers of each label's blocks."""
    numbers, n = {}, 0
    for r in rows.groupBy("label").count().orderBy("label").collect():  # a row for each label
        numbers[r["label"]] = range(n, n + max(1, -(-r["count"] // block)))
        n = numbers[r["label"]].stop
    d = rows.select("id", F.array(*[F.get("v", F.lit(k)) for k in order]).alias("v"), _of(numbers, lambda r: r.start).alias("first"), _of(numbers, len).alias("n"), "label")
    d = d.withColumn("number", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).cast("int"))
    d = d.groupBy("label", "number").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("rows"))
    return d.select("label", "number", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("vectors")), numbers


def _of(numbers: dict[int, range], what: Callable[[range], int]) -> Column:
    """what of the block numbers of a row's label."""
    return F.create_map(*[F.lit(x) for label, r in numbers.items() for x in (label, what(r))])[F.col("label")]


class Index:
    """The rows of a block for thresholds of at least t (a score per unit of the largest anchor norm)."""

    def __init__(self, x: np.ndarray, t: float):
        dims = x.shape[1]
        self.steps = [slice(a, min(a + STEP, dims)) for a in range(0, dims, STEP)]
        energy = np.stack([(x[:, s] ** 2).sum(axis=1) for s in self.steps], axis=1)
        norms = np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(energy, axis=1)], axis=1))
        # the first indexed step: all before are covered by their norm
        cut = (norms[:, 1:] < t).sum(axis=1)
        self.row = np.argsort(cut, kind="stable")
        self.x, self.cut, self.norms = x[self.row], cut[self.row], norms[self.row]
        self.indexed = np.searchsorted(self.cut, np.arange(len(self.steps)), side="right")

    def join(self, q: np.ndarray, t: np.ndarray, share: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, row and score of all pairs whose score is at least the query's threshold."""
        energy = np.stack([(q[:, s] ** 2).sum(axis=1) for s in self.steps], axis=1)
        q_norms = np.sqrt(np.concatenate([np.zeros((len(q), 1)), np.cumsum(energy, axis=1)], axis=1))
        slack = t - 1e-6 * (1 + q_norms[:, -1] * self.norms[:, -1].max(initial=0))
        done = np.full(len(self.x), len(self.steps))
        acc = np.zeros((len(q), len(self.x)))
        for k in range(len(self.steps) - 1, -1, -1):
            s, n = self.steps[k], self.indexed[k]
            acc[:, :n] += q[:, s] @ self.x[:n, s].T
            done[:n] = k
            live = acc + q_norms[:, done] * self.norms[np.arange(len(done)), done] >= slack[:, None]
            if live.mean() <= share:
                break
        a, b = np.nonzero(live)
        left, score = done[b], acc[a, b]
        for k in range(int(left.max(initial=0)) - 1, -1, -1):  # what is left of the dimensions, omitted ones included
            s, more = self.steps[k], left > k
            score[more] += np.einsum("ij,ij->i", q[a[more], s], self.x[b[more], s])
            left[more] = k
            ok = score + q_norms[a, left] * self.norms[b, left] >= slack[a]
            a, b, left, score = a[ok], b[ok], left[ok], score[ok]
        ok = score >= t[a]
        return a[ok], self.row[b[ok]], score[ok]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of each group with the highest scores, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[rank < k]


def _meetings(anchors: DataFrame, blocks: DataFrame, numbers: dict[int, range], own: bool, columns: list[str]) -> DataFrame:
    """number, ids, vectors, label, q_...: each block, then the packs of some PACK anchors of one label that meet it: those of its label, or all others.

    A block and its packs are rows of one partition. They are not joined: packs times blocks grow faster than the input, and Spark, which judges
    the packs by the anchors' file, would broadcast all their rows by way of the driver.
    """
    n = max(r.stop for r in numbers.values())
    d = anchors.groupBy("label", "pack").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    first, last = _of(numbers, lambda r: r.start), _of(numbers, lambda r: r.stop - 1)
    met = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k.between(first, last) if own else ~k.between(first, last))
    d = d.select(F.explode(met).alias("number"), "label", *[(F.flatten(f"rows.{c}") if c == "vector" else F.col(f"rows.{c}")).alias(f"q_{c}") for c in columns])
    rows = blocks.drop("label").unionByName(d, allowMissingColumns=True)
    return rows.repartitionById(n, F.col("number")).sortWithinPartitions("number", F.isnull("ids"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, pa.Scalar]]]:
    """ids and vectors of a block, and a pack that meets it, pack by pack. A block without rows has packs all the same; they are passed over."""
    here = None
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r] for c in batch.schema.names}
            number = row["number"].as_py()
            if row["ids"].is_valid:
                ids = np.asarray(row["ids"].values)
                first = np.append(True, ids[1:] != ids[:-1])  # of rows with one id, the first
                here, ids, x = number, ids[first], np.asarray(row["vectors"].values).reshape(len(ids), -1)[first]
            elif number == here:
                yield ids, x, row


def _positive_round(anchors: DataFrame, blocks: DataFrame, numbers: dict[int, range], share: float | None, most: float, k: int) -> DataFrame:
    """anchor, label, id, score: the best k rows of each anchor's own label that reach the round's threshold, from each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, pack in _met(batches):
            q_ids = np.asarray(pack["q_anchor"].values)
            q = np.asarray(pack["q_vector"].values).reshape(len(q_ids), -1)
            norm = np.sqrt((q * q).sum(axis=1))
            t = np.full(len(q), -np.inf) if share is None else share * most * norm
            a, b, score = Index(x, -1.0 if share is None else share * most).join(q, t)
            other = q_ids[a] != ids[b]
            a, b, score = a[other], b[other], score[other]
            at = _first(a, score, ids[b], k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[a[at]]), pa.array(np.full(len(at), pack["label"].as_py(), np.int32)), pa.array(ids[b[at]]), pa.array(score[at].astype(np.int64))], names=["anchor", "label", "id", "score"])

    return _meetings(anchors, blocks, numbers, True, ["anchor", "vector"]).mapInArrow(run, "anchor long, label int, id long, score long")


def _negative_round(anchors: DataFrame, blocks: DataFrame, numbers: dict[int, range], share: int, k: int) -> DataFrame:
    """anchor, positive_score, id, score: the best k rows of other labels in each open window, from each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, pack in _met(batches):
            q_ids = np.asarray(pack["q_anchor"].values)
            q = np.asarray(pack["q_vector"].values).reshape(len(q_ids), -1)
            tops = [np.asarray(w.values) for w in pack["q_tops"].values]
            norm = np.sqrt((q * q).sum(axis=1))
            least = np.array([-(-share * int(w.min()) // 100) for w in tops], dtype=float)
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.min(np.where(norm > 0, least / norm, 0))
            a, b, score = Index(x, float(t)).join(q, least)
            other = q_ids[a] != ids[b]
            a, b, score = a[other], b[other], score[other].astype(np.int64)
            size = np.array([len(w) for w in tops])
            top, begin = np.concatenate(tops), np.cumsum(size) - size
            for j in range(int(size.max(initial=0))):  # the windows of an anchor are few: one for each of its positive scores
                has = size[a] > j
                p = np.where(has, top[np.minimum(begin[a] + j, len(top) - 1)], 0)
                at = np.flatnonzero(has & (score <= p) & (100 * score >= share * p))
                at = at[_first(a[at], score[at], ids[b[at]], k)]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a[at]]), pa.array(p[at]), pa.array(ids[b[at]]), pa.array(score[at])], names=["anchor", "positive_score", "id", "score"])

    return _meetings(anchors, blocks, numbers, False, ["anchor", "vector", "tops"]).mapInArrow(run, "anchor long, positive_score long, id long, score long")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k rows of each group with their rank; n is how many of them there are."""
    w = Window.partitionBy(*by)
    d = found.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return d.withColumn("n", F.count("*").over(w))


def _without(table: DataFrame, done: list[DataFrame], by: list[str]) -> DataFrame:
    """The rows of table whose key is in none of the others. These grow with the anchors, so they are not broadcast."""
    return table.join(_all(done[1:], done[0].select(*by)).hint("merge"), by, "left_anti") if done else table


def _all(tables: list[DataFrame], empty: DataFrame) -> DataFrame:
    for t in tables:
        empty = empty.union(t.select(*empty.columns))
    return empty


def _anchors(blocks: DataFrame, is_anchor: Column, dims: int) -> DataFrame:
    """anchor, label, vector, pack: anchors from the blocks, so that one row of each id counts; packs hold some PACK of a label."""
    d = blocks.select("label", F.posexplode("ids").alias("k", "id"), F.col("ids").alias("_ids"), "vectors").filter(is_anchor)
    d = d.filter((F.col("k") == 0) | (F.get("_ids", F.col("k") - 1) != F.col("id")))
    return d.select(F.col("id").alias("anchor"), "label", F.slice("vectors", F.col("k") * dims + 1, F.lit(dims)).alias("vector"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor is over the column id, label over vectors."""
    spark = vectors.sparkSession
    rows = written(prepared(vectors, label), "hardneg-rows")
    order, most = _order(rows)
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not order:
        return none
    blocks, numbers = _blocks(rows, order, block)
    blocks = written(blocks, "hardneg-blocks")
    dropped(rows)
    anchors = written(_anchors(blocks, is_anchor, len(order)), "hardneg-anchors")
    packs = max(1, -(-anchors.count() // PACK))
    anchors = anchors.withColumn("pack", F.pmod(F.xxhash64("anchor"), F.lit(packs)))

    taken = []
    for share in POSITIVE_ROUNDS:
        left = _without(anchors, taken, ["anchor"])
        if left.isEmpty():
            break
        found = written(_ranked(_positive_round(left, blocks, numbers, share, most, positives), ["anchor", "label"], positives), "positives")
        taken.append(found if share is None else found.filter(F.col("n") >= positives))
    chosen = written(_all(taken, spark.createDataFrame([], "anchor long, id long, score long")), "chosen-positives")

    windows = chosen.filter("score >= 0").select("anchor", F.col("score").alias("positive_score")).distinct()
    taken = []
    for share in NEGATIVE_ROUNDS:
        left = _without(windows, taken, ["anchor", "positive_score"])
        if left.isEmpty():
            break
        tops = left.groupBy("anchor").agg(F.sort_array(F.collect_list("positive_score")).alias("tops"))
        found = written(_ranked(_negative_round(anchors.join(tops.hint("merge"), "anchor"), blocks, numbers, share, negatives), ["anchor", "positive_score"], negatives), "negatives")
        taken.append(found if share == LEAST else found.filter(F.col("n") >= negatives))
    found = _all(taken, spark.createDataFrame([], "anchor long, positive_score long, rank int, id long, score long"))
    p = chosen.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    n = found.select(F.col("anchor").alias("anchor_id"), "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return p.join(n.hint("merge"), ["anchor_id", "positive_score"]).select(*none.columns)
