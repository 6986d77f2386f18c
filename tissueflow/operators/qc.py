"""Filtering and normalising count tables. A missing row is a zero, so numbers of spots come from the obs table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPOT = ["sample_id", "spot_id"]
GENE = ["sample_id", "gene"]
# Prefixes of control probes.
CONTROLS = ("BLANK_", "NegControlCodeword_", "NegControlProbe_", "antisense_")


def filter_genes(expression: DataFrame, obs: DataFrame, min_total: float = 200, min_share: int | None = 10, min_spots: int = 0) -> DataFrame:
    """Genes with a total of min_total, and seen in a min_share-th of the sample's spots (whole) or in min_spots."""
    g = expression.groupBy(*GENE).agg(F.sum("count").alias("total"), F.count_if(F.col("count") > 0).alias("seen"))
    n = obs.groupBy("sample_id").agg(F.count("*").alias("n"))
    least = F.floor(F.col("n") / min_share) if min_share else F.lit(min_spots)
    keep = g.join(n, "sample_id").filter((F.col("total") >= min_total) & (F.col("seen") >= least)).select(*GENE)
    return expression.join(keep, GENE, "left_semi")


def filter_spots(expression: DataFrame, min_total: float = 20) -> DataFrame:
    """Spots whose total over the genes that are left is min_total or more."""
    keep = expression.groupBy(*SPOT).agg(F.sum("count").alias("total")).filter(F.col("total") >= min_total).select(*SPOT)
    return expression.join(keep, SPOT, "left_semi")


def filter_cell_genes(expression: DataFrame, min_cells: int = 5) -> DataFrame:
    """Genes seen in min_cells cells of their sample; cells are not filtered."""
    keep = expression.groupBy(*GENE).agg(F.count_if(F.col("count") > 0).alias("seen")).filter(F.col("seen") >= min_cells).select(*GENE)
    return expression.join(keep, GENE, "left_semi")


def without_mitochondrial(expression: DataFrame) -> DataFrame:
    return expression.filter(~F.col("gene").startswith("MT-"))


def without_controls(genes: DataFrame, column: str = "gene") -> DataFrame:
    return genes.filter(~F.col(column).rlike("^(" + "|".join(CONTROLS) + ")"))


def reference_qc(expression: DataFrame, min_genes: int = 200, min_total: float = 10) -> DataFrame:
    """Cells with min_genes detected genes, then genes with a total of min_total in those."""
    cells = expression.groupBy("cell_id").agg(F.count_if(F.col("count") > 0).alias("n")).filter(F.col("n") >= min_genes).select("cell_id")
    d = expression.join(cells, "cell_id", "left_semi")
    genes = d.groupBy("gene").agg(F.sum("count").alias("t")).filter(F.col("t") >= min_total).select("gene")
    return d.join(genes, "gene", "left_semi")


def keep_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is one of the values (tissues, cell types, clusters)."""
    return df.filter(F.col(column).isin(*values))


def check_counts(expression: DataFrame, mode: str = "sum", skip: bool = False) -> None:
    """Finite; unless skipped, not negative, and a whole total for mode 'sum'. One pass."""
    c = F.col("count").cast("double")
    r = expression.agg(F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias("odd"), F.min(c).alias("least"), F.sum(c).alias("total")).first()
    if r["odd"]:
        raise ValueError("counts hold nan or infinite values")
    if skip or r["total"] is None:
        return
    if r["least"] < 0:
        raise ValueError("counts hold negative values")
    if mode == "sum" and not float(r["total"]).is_integer():
        raise ValueError("counts are not whole numbers")


def count_report(expression: DataFrame) -> DataFrame:
    """What check_counts looks at, as a row."""
    c = F.col("count").cast("double")
    return expression.agg(F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias("n_not_finite"), F.min(c).alias("least"), F.sum(c).alias("total"), (F.sum(c) % 1).alias("fraction"))


def size_factors(expression: DataFrame, obs: DataFrame) -> DataFrame:
    """Each spot's total and its ratio to the sample's median total; spots without counts have total 0."""
    t = expression.groupBy(*SPOT).agg(F.sum("count").alias("total"))
    t = obs.select(*SPOT).join(t, SPOT, "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    m = t.groupBy("sample_id").agg(F.median("total").alias("median_total"))
    return t.join(m, "sample_id").withColumn("size_factor", F.try_divide("total", "median_total"))


def normalise_total(expression: DataFrame, target: float = 1e4, keys: Sequence[str] = SPOT) -> DataFrame:
    """value = count * target / the spot's total; spots of total zero stay zero."""
    t = expression.groupBy(*keys).agg(F.sum("count").alias("_total"))
    return expression.join(t, list(keys)).withColumn("value", F.coalesce(F.try_divide(F.col("count") * target, F.col("_total")), F.lit(0.0))).drop("_total")


def normalise_median(expression: DataFrame, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """value = count * median total / total, the median over totals that are not zero."""
    t = expression.groupBy(*keys).agg(F.sum("count").alias("_total"))
    m = t.filter("_total <> 0").agg(F.median("_total").alias("_median"))
    return expression.join(t, list(keys)).crossJoin(F.broadcast(m)).withColumn("value", F.coalesce(F.try_divide(F.col("count") * F.col("_median"), F.col("_total")), F.lit(0.0))).drop("_total", "_median")


def log1p(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.log1p(column))


def log10_normalised(expression: DataFrame, target: float = 1e4) -> DataFrame:
    return normalise_total(expression, target).withColumn("value", F.log10(1 + F.col("value")))


def densify(values: DataFrame, obs: DataFrame, genes: DataFrame, column: str = "value") -> DataFrame:
    """A row for every spot and every gene of the panel that is measured at all, zeros filled in."""
    every = obs.select(*SPOT).crossJoin(genes.select("gene").distinct().join(values.select("gene").distinct(), "gene", "left_semi"))
    return every.join(values.select(*SPOT, "gene", column), [*SPOT, "gene"], "left").withColumn(column, F.coalesce(column, F.lit(0.0)))


def robust_scale(values: DataFrame, mode: str = "global_scaling", column: str = "value", obs: DataFrame | None = None) -> DataFrame:
    """value / (95th percentile - minimum) of its gene, over all samples or each; no range: unchanged. Other modes: none.

    With obs, rows that are absent are zeros: they stay zeros, and count in the percentile by their number alone.
    """
    if mode not in ("global_scaling", "slide_scaling"):
        return values
    by = [] if mode == "global_scaling" else ["sample_id"]
    held = values.groupBy(*by, "gene", column).agg(F.count("*").alias("_n"))
    if obs is not None:
        spots = obs.groupBy(*by).agg(F.count("*").alias("_spots"))
        seen = held.groupBy(*by, "gene").agg(F.sum("_n").alias("_n"))
        zeros = (seen.join(spots, by) if by else seen.crossJoin(F.broadcast(spots))).select(*by, "gene", F.lit(0.0).alias(column), (F.col("_spots") - F.col("_n")).alias("_n"))
        held = held.union(zeros.filter("_n > 0"))
    s = held.groupBy(*by, "gene").agg((F.percentile(column, 0.95, F.col("_n")) - F.min(column)).alias("_range"))
    scaled = F.col(column) / F.when(F.col("_range") == 0, 1.0).otherwise(F.col("_range"))
    return values.join(s, [*by, "gene"]).withColumn(column, scaled).drop("_range")


@dataclass(frozen=True)
class Technology:
    """How one technology's samples are filtered; further ones are further instances."""

    name: str
    gene_total: float
    gene_share: int | None
    gene_spots: int
    spot_total: float

    def prepare(self, expression: DataFrame, obs: DataFrame) -> DataFrame:
        """Gene filter, spot filter, then mitochondrial genes go: in this order."""
        d = filter_genes(expression, obs, self.gene_total, self.gene_share, self.gene_spots)
        return without_mitochondrial(filter_spots(d, self.spot_total) if self.spot_total else d)


VISIUM = Technology("Visium", 200, 10, 0, 20)
XENIUM = Technology("Xenium", 0, None, 5, 0)
TECHNOLOGIES = {t.name: t for t in (VISIUM, XENIUM)}


def log_normalised(expression: DataFrame) -> DataFrame:
    return log1p(normalise_total(expression))


