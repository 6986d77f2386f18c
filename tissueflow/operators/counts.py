"""From transcripts to a cell by gene table, long and sparse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["sample_id", "cell_id"]


def quality_transcripts(transcripts: DataFrame, min_qv: float = 20) -> DataFrame:
    """Transcripts of a cell with a quality above min_qv."""
    return transcripts.filter((F.col("cell_id") != "UNASSIGNED") & (F.col("qv") > min_qv))


def quality_report(transcripts: DataFrame, min_qv: float = 20) -> DataFrame:
    """Per sample the share of transcripts kept and the number of cells that keep any; one pass."""
    ok = (F.col("cell_id") != "UNASSIGNED") & (F.col("qv") > min_qv)
    return transcripts.groupBy("sample_id").agg(
        F.count("*").alias("n_transcripts"),
        F.count_if(ok).alias("n_kept"),
        (100.0 * F.count_if(ok) / F.count("*")).alias("percent_kept"),
        F.count_distinct(F.when(ok, F.col("cell_id"))).alias("n_cells"),
    )


def count_transcripts(transcripts: DataFrame) -> DataFrame:
    """sample_id, cell_id, gene, count."""
    return transcripts.groupBy(*CELL, F.col("feature_name").alias("gene")).agg(F.count("*").cast("double").alias("count"))


def align_counts(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts of segmented cells only; cells without transcripts stay in cells, which is the obs table."""
    return counts.join(cells.select(*CELL).distinct(), CELL, "left_semi")


def cells_without_transcripts(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Segmented cells that no transcript names."""
    return cells.select(*CELL).join(counts.select(*CELL), CELL, "left_anti")


def overlap_report(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Per sample: segmented cells, those with transcripts, those without."""
    with_counts = counts.select(*CELL).distinct().withColumn("has", F.lit(1))
    d = cells.select(*CELL).distinct().join(with_counts, CELL, "left")
    return d.groupBy("sample_id").agg(F.count("*").alias("n_cells"), F.count("has").alias("n_with"), (F.count("*") - F.count("has")).alias("n_without"))


def attach_centroids(obs: DataFrame, cells: DataFrame) -> DataFrame:
    """obs with the cells' centroids, cut to whole pixels."""
    return obs.join(cells.select(*CELL, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")), CELL)
