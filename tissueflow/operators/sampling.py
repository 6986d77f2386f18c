"""Splits, samples and batches. Random order is a hash of the id and a seed, so it does not depend on partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.operators.scans import placed, plain, preceding, ranged, running


def _order(key: str, seed: int) -> Column:
    """60 bits of the md5 of seed and key, a rule that any engine can follow."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def _place(df: DataFrame, key: str, seed: int, bins: int = 4096) -> DataFrame:
    """df with place, the row's number (from 1) in the seeded order, without a sort in one task.

    Rows are numbered in each of bins ranges of the hash; the ranges' sizes (bins rows) give where each begins.
    """
    d = df.withColumn("_h", _order(key, seed)).withColumn("_bin", F.shiftright("_h", 48))
    sizes = d.groupBy("_bin").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_bin", (F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).alias("_before"))
    d = d.join(sizes, "_bin").withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy("_bin").orderBy("_h", key)))
    return d.drop("_h", "_bin", "_before")


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """df with train: exactly n - floor((1 - share) * n) rows of n."""
    n = df.count()
    k = n - math.floor((1 - share) * n + 1e-9)
    return _place(df, key, seed).withColumn("train", F.col("place") <= k).drop("place")


def halves(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df with train for the first floor(n / 2) rows of the seeded order."""
    k = df.count() // 2
    return _place(df, key, seed).withColumn("train", F.col("place") <= k).drop("place")


def subsample(df: DataFrame, key: str, n: int, by: str = "sample_id", seed: int = 0) -> DataFrame:
    """At most n rows of each sample, in key order."""
    w = Window.partitionBy(by).orderBy(_order(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r").orderBy(by, key)


def per_class(df: DataFrame, key: str, n: int, label: str = "class", seed: int = 0) -> DataFrame:
    """Up to n rows of each class."""
    return subsample(df, key, n, label, seed)


def pair_expression(cells: DataFrame, reference: DataFrame, mode: str, seed: int = 0) -> DataFrame:
    """cells (cell_idx, cell_type) with ref_cell: a random reference cell of their type, or of any type.

    A cell's draw is a hash modulo the number of reference cells; reference cells are numbered by hash within their type, so drawing is an equi-join.
    """
    if mode not in ("type", "random"):
        raise ValueError(f"no such mode: {mode}")
    ref = reference.select("cell_id", F.col("cell_type") if mode == "type" else F.lit("any").alias("cell_type"))
    # a type of any size is numbered in ranges of the order
    ref = plain(placed(ranged(ref.withColumn("_h", _order("cell_id", seed)), ["cell_type"], ["_h", "cell_id"]), ["cell_type"], "draw"), "_h")
    size = ref.groupBy("cell_type").agg(F.count("*").alias("n"))
    c = cells.withColumn("_type", F.col("cell_type") if mode == "type" else F.lit("any"))
    c = c.join(size.withColumnRenamed("cell_type", "_type"), "_type").withColumn("draw", F.pmod(_order("cell_idx", seed + 1), F.col("n")))
    ref = ref.select(F.col("cell_type").alias("_type"), "draw", F.col("cell_id").alias("ref_cell"))
    return c.join(ref, ["_type", "draw"]).drop("_type", "draw", "n")


def pair_mean_expression(cells: DataFrame, type_means: DataFrame) -> DataFrame:
    """Each cell with the mean profile of its type."""
    return cells.join(type_means, "cell_type").select("cell_idx", "gene", F.col("mean").alias("count"))


def draw_pseudo_spots(cells: DataFrame, n_spots: int, per_spot: int, key: str = "cell_idx", seed: int = 0) -> DataFrame:
    """spot, slot and cell: n_spots * per_spot draws with replacement."""
    n = cells.count()
    numbered = _place(cells.select(key), key, seed).withColumn("draw", F.col("place") - 1)
    draws = cells.sparkSession.range(n_spots * per_spot).select(F.floor(F.col("id") / per_spot).alias("spot"), (F.col("id") % per_spot).alias("slot"), F.pmod(_order("id", seed + 1), F.lit(n)).alias("draw"))
    return draws.join(numbered, "draw").select("spot", "slot", key)


def pseudo_spot_counts(draws: DataFrame, expression: DataFrame, key: str = "cell_idx") -> DataFrame:
    """The summed counts of each pseudo-spot's cells."""
    return draws.join(expression, key).groupBy("spot", "gene").agg(F.sum("count").alias("count"))


def batches(df: DataFrame, key: str, size: int, by: str = "sample_id", shuffle: bool = False, seed: int = 0) -> DataFrame:
    """df with batch (from 0 in each sample): blocks of size rows that never mix samples. A sample of any size is numbered in ranges."""
    d = df.withColumn("_h", _order(key, seed)) if shuffle else df
    t = placed(ranged(d, [by], ["_h", key] if shuffle else [key]), [by], "_place")
    return plain(t.withColumn("batch", F.floor(F.col("_place") / size)), "_place", "_h")


def bag_pointers(df: DataFrame, key: str, bag: str, by: Sequence[str] = ("sample_id", "batch")) -> DataFrame:
    """df with pointer: 0 for the batch's first bag, one more wherever the bag changes in key order."""
    by = list(by)
    t = preceding(ranged(df, by, [key], before={"_kept": bag}), by, bag, "_kept", "_before")
    change = F.when(F.col("_before") != F.col(bag), 1).otherwise(0).cast("long")
    t = ranged(plain(t.withColumn("_c", change), "_kept", "_before"), by, [key], sums={"_upto": "_c"})
    t = running(t, by, "_c", "_upto", "_changes")
    return plain(t.withColumn("pointer", F.col("_changes") + F.col("_c")), "_c", "_upto", "_changes")


def bag_offsets(df: DataFrame, bag: str, by: str = "sample_id") -> DataFrame:
    """by, bag, n and offset: where each bag begins when bags follow each other."""
    n = df.groupBy(by, bag).agg(F.count("*").alias("n"))
    return plain(running(ranged(n, [by], [bag], sums={"_upto": "n"}), [by], "n", "_upto", "offset"), "_upto")
