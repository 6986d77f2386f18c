"""Choosing genes: panels, variable, spatial, highly expressed and marker genes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tissueflow.functions.scalars import CLASS_LABELS
from tissueflow.operators.qc import without_controls
from tissueflow.operators.spatial import morans_i


def restrict_panel(expression: DataFrame, panel: DataFrame) -> DataFrame:
    """Rows of the panel's genes; none measured is an error."""
    out = expression.join(panel.select("gene").distinct(), "gene", "left_semi")
    if out.isEmpty():
        raise ValueError("no gene of the panel is measured")
    return out


def panel_report(expression: DataFrame, panel: DataFrame) -> DataFrame:
    """Genes of the panel (distinct, sorted) that are measured."""
    return panel.select("gene").distinct().join(expression.select("gene"), "gene", "left_semi").orderBy("gene")


def panel_union(expression: DataFrame) -> DataFrame:
    """Genes of any sample but control probes, sorted."""
    return without_controls(expression.select("gene").distinct()).orderBy("gene")


def common_genes(expression: DataFrame) -> DataFrame:
    """Genes that all samples have; none is an error."""
    n = expression.agg(F.count_distinct("sample_id")).first()[0]
    out = expression.groupBy("gene").agg(F.count_distinct("sample_id").alias("n")).filter(F.col("n") == n).select("gene")
    if out.isEmpty():
        raise ValueError("samples have no gene in common")
    return out


def stack(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Samples one below the other on their common genes, with their batch and unique row ids."""
    every = None
    for name, part in parts.items():
        part = part.withColumn("batch", F.lit(name)).withColumn("row_id", F.concat_ws("_", "spot_id", F.lit(name)))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    shared = every.groupBy("gene").agg(F.count_distinct("batch").alias("n")).filter(F.col("n") == len(parts)).select("gene")
    return every.join(shared, "gene", "left_semi")


def unique_names(genes: DataFrame) -> DataFrame:
    """Later rows (by pos) of one name get -1, -2, ...; numbers already in use by other names are passed over."""
    d = genes.withColumn("k", F.row_number().over(Window.partitionBy("gene").orderBy("pos")) - 1)
    stem, number = F.regexp_extract("gene", r"^(.*)-([0-9]{1,9})$", 1), F.regexp_extract("gene", r"^(.*)-([0-9]{1,9})$", 2)
    used = genes.select(stem.alias("stem"), number.alias("n")).filter("n <> ''").groupBy("stem").agg(F.array_sort(F.collect_set(F.col("n").cast("int"))).alias("used"))
    d = d.join(used.withColumnRenamed("stem", "gene"), "gene", "left")
    # the k-th number that is free: step over each used one that is not larger
    free = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("k"), lambda k, u: F.when((u > 0) & (u <= k), k + 1).otherwise(k))
    return d.withColumn("unique", F.when(F.col("k") == 0, F.col("gene")).otherwise(F.concat_ws("-", "gene", free.cast("string")))).drop("k", "used")


def _local_fit(xs: np.ndarray, ys: np.ndarray, at: float, q: int) -> tuple[float, float]:
    """Value and slope at one place of the quadratic fitted to the q nearest points (xs in order), with tricube weights."""
    left = int(np.clip(np.searchsorted(xs, at) - q // 2, 0, len(xs) - q))
    while left + q < len(xs) and xs[left + q] - at < at - xs[left]:
        left += 1
    while left > 0 and at - xs[left - 1] < xs[left + q - 1] - at:
        left -= 1
    a, b = xs[left : left + q] - at, ys[left : left + q]
    h = max(np.abs(a).max(), 1e-12)
    w = np.sqrt((1 - np.minimum(np.abs(a) / h, 1) ** 3) ** 3)
    places = np.unique(a[w > 0])
    if not len(places):  # all equally far
        w, places = np.ones_like(a), np.unique(a)
    m = np.stack([(a / h) ** k for k in range(min(3, len(places)))], axis=1) * w[:, None]
    value, *slope = np.linalg.lstsq(m, b * w, rcond=None)[0]
    return float(value), float(slope[0]) / h if slope else 0.0


def _vertices(xs: np.ndarray, most: int, margin: float = 0.1) -> np.ndarray:
    """Ends of the cells of a k-d tree over xs (in order): cells of more than most points are cut at their median."""
    reach = margin * max(float(xs[-1] - xs[0]), 1e-10 * float(np.abs(xs).max()) + 1e-30)
    cuts, cells = [float(xs[0]) - reach, float(xs[-1]) + reach], [(0, len(xs))]
    while cells:
        a, b = cells.pop()
        if b - a > most and xs[a] < xs[b - 1]:
            m = int(np.searchsorted(xs[a:b], xs[(a + b) // 2])) + a  # equal points stay together
            m = m if m > a else int(np.searchsorted(xs[a:b], xs[a], side="right")) + a
            cuts.append((float(xs[m - 1]) + float(xs[m])) / 2)
            cells += [(a, m), (m, b)]
    return np.unique(cuts)


def _loess(x: np.ndarray, y: np.ndarray, span: float, cell: float = 0.2) -> np.ndarray:
    """Local quadratic regression at each x: fitted with its slope at the vertices of a k-d tree, blended by cubics between them.

    A cell has at most span * cell of all points, so the number of fits does not grow with the points, and the whole is linear in them.
    """
    order = np.argsort(x, kind="stable")
    xs, ys = np.asarray(x, dtype=float)[order], np.asarray(y, dtype=float)[order]
    n = len(xs)
    q = max(min(3, n), min(n, int(np.ceil(span * n))))
    at = _vertices(xs, max(1, int(n * span * cell)))
    value, slope = np.array([_local_fit(xs, ys, v, q) for v in at]).T
    k = np.clip(np.searchsorted(at, x, side="right") - 1, 0, len(at) - 2)
    h = at[k + 1] - at[k]
    t = (x - at[k]) / h
    return (1 + 2 * t) * (1 - t) ** 2 * value[k] + t * (1 - t) ** 2 * h * slope[k] + t * t * (3 - 2 * t) * value[k + 1] - t * t * (1 - t) * h * slope[k + 1]


def highly_variable(expression: DataFrame, obs: DataFrame, n: int, keys: Sequence[str] = (), span: float = 0.3) -> DataFrame:
    """keys, gene, mean, variance, score (variance of clipped, standardised counts) and rank (from 1) of the n best.

    Two passes over the counts; between them a curve is fitted to one row for each gene, batches side by side.
    """
    keys = list(keys)
    size = obs.groupBy(*keys).agg(F.count("*").alias("n")) if keys else obs.agg(F.count("*").alias("n"))
    m = expression.groupBy(*keys, "gene").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("ss"))
    m = m.join(size, keys) if keys else m.crossJoin(F.broadcast(size))
    mean = F.col("s") / F.col("n")
    m = m.select(*keys, "gene", "n", mean.alias("mean"), F.try_divide(F.col("ss") - F.col("n") * mean * mean, F.col("n") - 1).alias("variance"))
    schema = StructType([*m.schema.fields, StructField("sd", DoubleType())])

    def fit(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("gene")
        return one.assign(sd=np.sqrt(10.0 ** _loess(np.log10(one["mean"].to_numpy()), np.log10(one["variance"].to_numpy()), span)))

    curve = m.filter("variance > 0").groupBy(*keys or [F.lit("all").alias("_all")]).applyInPandas(fit, schema)  # one row for each gene of a batch
    clipped = F.least(F.col("count").cast("double"), F.col("sd") * F.sqrt("n") + F.col("mean"))
    own = [F.first(c).alias(c) for c in ("n", "mean", "variance", "sd")]
    d = expression.join(curve, [*keys, "gene"]).withColumn("c", clipped).groupBy(*keys, "gene").agg(*own, F.sum("c").alias("c1"), F.sum(F.col("c") * F.col("c")).alias("c2"))
    score = (F.col("n") * F.col("mean") * F.col("mean") + F.col("c2") - 2 * F.col("mean") * F.col("c1")) / ((F.col("n") - 1) * F.col("sd") * F.col("sd"))
    d = d.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(*keys or [F.lit(1)]).orderBy(F.desc("score"), "gene"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= n).select(*keys, "gene", "mean", "variance", "score", "rank")


def common_highly_variable(expression: DataFrame, obs: DataFrame, n: int, batch: str = "sample_id") -> DataFrame:
    """gene, median_rank and n_batches: genes by their median rank over batches (ranks beyond n do not count), then by more batches."""
    r = highly_variable(expression, obs, n, [batch])
    d = r.groupBy("gene").agg(F.median("rank").alias("median_rank"), F.count("*").alias("n_batches"))
    return d.orderBy("median_rank", F.desc("n_batches"), "gene").limit(n)


def spatially_variable(expression: DataFrame, spots: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The n genes of highest Moran's I in each sample."""
    d = morans_i(expression, spots, edges).filter("i is not null")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("i"), "gene"))).filter(F.col("rank") <= n)


def common_spatially_variable(moran: DataFrame, n: int) -> DataFrame:
    """Genes by the geometric mean of I over samples; negative I is skipped, zero makes it zero."""
    log = F.when(F.col("i") > 0, F.ln("i")).when(F.col("i") == 0, F.lit(float("-inf")))
    return moran.groupBy("gene").agg(F.exp(F.avg(log)).alias("score")).filter("score is not null").orderBy(F.desc("score"), "gene").limit(n)


def common_highly_expressed(expression: DataFrame, obs: DataFrame, n: int) -> DataFrame:
    """Genes by the mean over samples of their mean; a sample that lacks a gene has mean zero for it."""
    size = obs.groupBy("sample_id").agg(F.count("*").alias("n"))
    m = expression.groupBy("sample_id", "gene").agg(F.sum("count").alias("s")).join(size, "sample_id").groupBy("gene").agg(F.sum(F.col("s") / F.col("n")).alias("t"))
    k = size.agg(F.count("*").alias("k"))
    return m.crossJoin(F.broadcast(k)).select("gene", (F.col("t") / F.col("k")).alias("score")).orderBy(F.desc("score"), "gene").limit(n)


def rank_markers(expression: DataFrame, obs: DataFrame, group: str = "cell_type", value: str = "value") -> DataFrame:
    """group, gene, score: t of each group against the rest, the rest's number taken as the group's own.

    The rest is the total less the group, so one pass over the counts serves all groups.
    """
    sizes = obs.groupBy(group).agg(F.count("*").alias("n"))
    d = expression.join(obs.select("cell_id", group), "cell_id").groupBy(group, "gene").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    whole = d.groupBy("gene").agg(F.sum("s").alias("ts"), F.sum("ss").alias("tss"))
    total = sizes.agg(F.sum("n").alias("tn"))
    every = whole.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(total)).join(d, [group, "gene"], "left").na.fill(0.0, ["s", "ss"])
    n, r = F.col("n"), F.col("tn") - F.col("n")
    m, mr = F.col("s") / n, F.try_divide(F.col("ts") - F.col("s"), r)
    v = F.greatest(F.lit(0.0), F.try_divide(F.col("ss") - n * m * m, n - 1))
    vr = F.greatest(F.lit(0.0), F.try_divide(F.col("tss") - F.col("ss") - r * mr * mr, r - 1))
    return every.select(group, "gene", F.coalesce(F.try_divide(m - mr, F.sqrt(v / n + vr / n)), F.lit(0.0)).alias("score"))


def merge_groups(df: DataFrame, column: str, merged: Mapping[str, str]) -> DataFrame:
    """Rename groups, so that several become one."""
    c = F.col(column)
    for old, new in merged.items():
        c = F.when(F.col(column) == old, new).otherwise(c)
    return df.withColumn(column, c)


def top_markers(scores: DataFrame, n: int = 20, group: str = "cell_type") -> DataFrame:
    """The n best genes of each group by score (to nine places, ties by name); the gene stays in its row, so equal scores do not fan out."""
    w = Window.partitionBy(group).orderBy(F.round("score", 9).desc(), "gene")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def marker_union(top: DataFrame) -> DataFrame:
    return top.select("gene").distinct().orderBy("gene")


def marker_mask(genes: DataFrame, signature: DataFrame, classes: Mapping[str, int] = CLASS_LABELS) -> DataFrame:
    """class, gene, mask: 1 where the gene marks the class; genes that mark none are 1 for all."""
    spark = genes.sparkSession
    every = genes.select("gene").distinct().crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in classes], "celltype string")))
    marks = signature.select("gene", "celltype").distinct().withColumn("mark", F.lit(1))
    d = every.join(marks, ["gene", "celltype"], "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    some = F.max("mark").over(Window.partitionBy("gene"))
    return d.select("celltype", "gene", F.when(some == 0, 1).otherwise(F.col("mark")).alias("mask"))


def marker_set_score(expression: DataFrame, obs: DataFrame, sets: DataFrame, value: str = "value") -> DataFrame:
    """sample_id, spot_id, set, score: the mean of the set's measured genes in each spot."""
    s = sets.select("set", "gene").distinct().join(expression.select("gene").distinct(), "gene")
    size = s.groupBy("set").agg(F.count("*").alias("k"))
    total = expression.join(s, "gene").groupBy("sample_id", "spot_id", "set").agg(F.sum(value).alias("t"))
    every = obs.select("sample_id", "spot_id").crossJoin(F.broadcast(size))
    return every.join(total, ["sample_id", "spot_id", "set"], "left").select("sample_id", "spot_id", "set", (F.coalesce("t", F.lit(0.0)) / F.col("k")).alias("score"))
