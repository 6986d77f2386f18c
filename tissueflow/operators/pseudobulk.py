"""Profiles of groups of cells."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.operators.aggregates import Aggregate, OfAll, aggregated
from tissueflow.operators.qc import check_counts


def group_stats(expression: DataFrame, obs: DataFrame, keys: Sequence[str], min_cells: int = 10, min_counts: float = 1000) -> DataFrame:
    """keys, n_cells, counts and passed (both limits, each at least 1)."""
    totals = expression.groupBy("cell_id").agg(F.sum("count").alias("t"))
    d = obs.select("cell_id", *keys).join(totals, "cell_id", "left").groupBy(*keys).agg(F.count("*").alias("n_cells"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("counts"))
    return d.withColumn("passed", (F.col("n_cells") >= max(1, min_cells)) & (F.col("counts") >= max(1, min_counts)))


def pseudobulk(expression: DataFrame, obs: DataFrame, sample: str = "sample_id", groups: str | Sequence[str] | None = None, mode: str = "sum", min_cells: int = 10, min_counts: float = 1000, remove_empty: bool = True, skip_checks: bool = False) -> DataFrame:
    """keys, gene, value, prop (share of cells that express it), n_cells, counts: one profile for each sample (and group).

    Profiles below the limits are zero and so, like genes zero everywhere, have no rows. Mode is sum, mean or median; zeros count.
    Without remove_empty every sample (with every group) has a row for every gene of expression: zeros for profiles below the
    limits and for absent pairs, whose n_cells and counts are null. Unless skipped, one pass first checks the counts (check_counts).
    """
    check_counts(expression, mode, skip_checks)
    keys, obs = _keys(obs, sample, groups)
    stats = group_stats(expression, obs, keys, min_cells, min_counts).filter("passed").drop("passed")
    counts = expression.filter("count <> 0").join(obs.select("cell_id", *keys), "cell_id")
    if mode == "median":
        runs = counts.groupBy(*keys, "gene", F.col("count").cast("double").alias("count")).agg(F.count("*").alias("m"))
        seen = runs.groupBy(*keys, "gene").agg(F.sum("m").alias("k")).join(stats, keys)
        zeros = seen.select(*keys, "gene", F.lit(0.0).alias("count"), (F.col("n_cells") - F.col("k")).alias("m")).filter("m > 0")
        v = seen.join(runs.union(zeros).groupBy(*keys, "gene").agg(F.percentile("count", 0.5, F.col("m")).alias("value")), [*keys, "gene"])
    else:
        v = counts.groupBy(*keys, "gene").agg(F.count("*").alias("k"), F.sum("count").alias("value")).join(stats, keys)
        if mode == "mean":
            v = v.withColumn("value", F.col("value") / F.col("n_cells"))
        elif mode != "sum":
            raise ValueError(f"no such mode: {mode}")
    v = v.filter("value <> 0").select(*keys, "gene", "value", (F.col("k") / F.col("n_cells")).alias("prop"), "n_cells", "counts")
    if remove_empty:
        return v
    pairs = obs.select(keys[0]).distinct()
    for k in keys[1:]:
        pairs = pairs.crossJoin(obs.select(k).distinct())  # one row for each profile
    every = pairs.join(group_stats(expression, obs, keys, min_cells, min_counts).drop("passed"), keys, "left").crossJoin(expression.select("gene").distinct())
    return every.join(v.select(*keys, "gene", "value", "prop"), [*keys, "gene"], "left").na.fill(0.0, ["value", "prop"]).select(*v.columns)


def _keys(obs: DataFrame, sample: str, groups: str | Sequence[str] | None) -> tuple[list[str], DataFrame]:
    if groups is None or groups == sample:
        return [sample], obs
    if isinstance(groups, str):
        return [sample, groups], obs
    name = "_".join(groups)
    return [sample, name], obs.withColumn(name, F.concat_ws("_", *groups))


def pseudobulk_with(expression: DataFrame, obs: DataFrame, keys: Sequence[str], functions: Mapping[str, Aggregate | Callable[[np.ndarray], float]], min_cells: int = 10, min_counts: float = 1000) -> DataFrame:
    """keys, gene and a column for each user aggregate over all values of the group's cells, zeros included.

    Aggregates are merged from parts, so that groups may have any size; a plain function is called with all values at once (see OfAll).
    """
    keys = list(keys)
    stats = group_stats(expression, obs, keys, min_cells, min_counts).filter("passed").select(*keys, "n_cells")
    d = expression.filter("count <> 0").join(obs.select("cell_id", *keys), "cell_id").join(stats, keys)
    kinds = {name: f if hasattr(f, "merge") else OfAll(f) for name, f in functions.items()}
    return aggregated(d, [*keys, "gene"], "n_cells", "count", kinds)


def constant_columns(obs: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Columns with one value (null is one) in every group."""
    each = obs.groupBy(*keys).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    r = each.agg(*[F.max(c).alias(c) for c in columns]).first()
    return [c for c in columns if r[c] == 1]


def with_constant_columns(profiles: DataFrame, obs: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """profiles with those columns of obs (all by default) that have one value in each group; profiles of absent groups have nulls.

    Groups whose value is null keep it, as null counts as a value.
    """
    keys = list(keys)
    columns = [c for c in (columns or obs.columns) if c not in (*keys, "cell_id") and c not in profiles.columns]
    same = constant_columns(obs, keys, columns) if columns else []
    if not same:
        return profiles
    return profiles.join(obs.groupBy(*keys).agg(*[F.max(c).alias(c) for c in same]), keys, "left")


def distinct_values(obs: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The most values that each column has in any group."""
    each = obs.groupBy(*keys).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    return each.agg(*[F.max(c).alias(c) for c in columns])


def expressed_genes(profiles: DataFrame, min_prop: float = 0.2, min_samples: int = 2, group: str | None = None) -> DataFrame:
    """Genes expressed in min_prop of the cells of min_samples profiles; with group, of any one group."""
    p = min(1.0, max(0.0, min_prop))
    by = [group, "gene"] if group else ["gene"]
    return profiles.groupBy(*by).agg(F.count_if(F.col("prop") >= p).alias("n")).filter(F.col("n") >= max(0, min_samples)).select("gene").distinct()


def type_means(expression: DataFrame, obs: DataFrame, group: str = "cell_type", value: str = "count") -> DataFrame:
    """Mean of each gene over all cells of a type."""
    n = obs.groupBy(group).agg(F.count("*").alias("n"))
    s = expression.join(obs.select("cell_id", group), "cell_id").groupBy(group, "gene").agg(F.sum(value).alias("s"))
    return s.join(n, group).select(group, "gene", (F.col("s") / F.col("n")).alias("mean"))
