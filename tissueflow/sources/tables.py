"""Readers and writers of the library's tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tissueflow.sources import cell_store

SAMPLES = "id string, species string, st_technology string, preservation_method string, subseries string, organ string"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample metadata from CSV, sorted by id."""
    return spark.read.csv(path, header=True, schema=SAMPLES, escape='"').orderBy("id")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The three columns that counting needs; Parquet reads no other."""
    d = spark.read.parquet(path)
    return d.select(*[c for c in ("sample_id",) if c in d.columns], "cell_id", "feature_name", "qv")


def read_expression(spark: SparkSession, path: str, sample_ids: Sequence[str] | None = None) -> DataFrame:
    """Expression of the given samples (all by default); spot names get their sample as suffix."""
    d = spark.read.parquet(path)
    if sample_ids is not None:
        d = d.filter(F.col("sample_id").isin(*sample_ids))
    return d.withColumn("spot_id", F.concat_ws("_", "spot_id", "sample_id"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells or embeddings; a missing label is -1, the spot name "None" is null."""
    d = spark.read.parquet(path)
    d = d.withColumn("label", F.coalesce(F.col("label") if "label" in d.columns else F.lit(None), F.lit(-1)).cast("int"))
    return d.withColumn("spot_id", F.nullif(F.col("spot_id"), F.lit("None"))) if "spot_id" in d.columns else d


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="gene string")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="idx int, `group` string, scores double, gene string").drop("idx")


def wide_counts(expression: DataFrame, genes: Sequence[str]) -> DataFrame:
    """spot and a column for each gene, zeros filled in."""
    wide = expression.groupBy(F.col("spot_id").alias("spot")).pivot("gene", list(genes)).agg(F.first("count"))
    return wide.fillna(0.0)


def export_spot_files(expression: DataFrame, spots: DataFrame, genes: Sequence[str], path: str, spot_diameter: float, scale: float) -> dict[str, float]:
    """cnts.tsv, locs-raw.tsv and gene-names.txt for spot super-resolution tools; returns radius and pixel size."""
    spark = expression.sparkSession
    wide_counts(expression, genes).write.csv(f"{path}/cnts.tsv", sep="\t", header=True)
    spots.select(F.col("spot_id").alias("spot"), "x", "y").write.csv(f"{path}/locs-raw.tsv", sep="\t", header=True)
    spark.createDataFrame([(g,) for g in genes], "value string").coalesce(1).write.text(f"{path}/gene-names.txt")
    return {"radius": 0.5 * spot_diameter, "pixel": 8000 / 2000 * scale}


def append_cells(batches: Iterable[DataFrame], path: str, load: str = "cells", replace: bool = True) -> None:
    """Write batches of cells to the store at path (see cell_store) as one load, which replaces what is there, or with replace=False adds to it."""
    named = ((f"batch-{k}", b) for k, b in enumerate(batches))
    spark = SparkSession.active()
    cell_store.append(spark, path, load, named, replace)


def save_results(df: DataFrame, path: str, exp_tag: str, test_slide: str, infer_mode: str) -> None:
    """Metrics or predictions under their experiment, slide and mode."""
    tagged = df.withColumns({"exp_tag": F.lit(exp_tag), "test_slide": F.lit(test_slide), "infer_mode": F.lit(infer_mode)})
    tagged.write.mode("append").partitionBy("exp_tag", "test_slide", "infer_mode").parquet(path)


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs below path: metrics.json records with the run's k=v overrides (.hydra/overrides.yaml, or overrides.txt) as columns.

    A key is what follows its last dot. A parameter becomes a number if every value of it parses.
    """
    run = lambda: F.regexp_extract("_metadata.file_path", r"([^/]+)/(?:metrics\.json|overrides\.txt|\.hydra/overrides\.yaml)", 1)
    found = [g for g in (f"{path}/*/.hydra/overrides.yaml", f"{path}/*/overrides.txt") if _exists(spark, g)]
    if not found:
        raise ValueError(f"no run of {path} has overrides")
    metrics = spark.read.json(f"{path}/*/metrics.json").withColumn("run", run())
    lines = spark.read.text(found).withColumn("run", run())
    pair = F.split(F.trim(F.regexp_replace("value", "^- *", "")), "=", 2)
    params = lines.filter(F.col("value").contains("=")).select("run", F.element_at(F.split(pair[0], "\\."), -1).alias("k"), pair[1].alias("v"))
    numbers = params.groupBy("k").agg(F.every(F.col("v").try_cast("double").isNotNull()).alias("number")).orderBy("k").collect()  # one row for each key
    wide = params.groupBy("run").pivot("k", [r["k"] for r in numbers]).agg(F.first("v"))
    for r in numbers:
        if r["number"]:
            wide = wide.withColumn(r["k"], F.col(r["k"]).cast("double"))
    return metrics.join(wide, "run", "left")


def without_samples(df: DataFrame, samples: DataFrame, condition: Column, key: str = "sample_id") -> DataFrame:
    """Rows of df but for the samples that meet the condition (by organ or by id); ids are compared whole."""
    gone = samples.filter(condition).select(F.col("id").alias(key)).distinct()
    return df.join(gone, key, "left_anti")


def save_panel(genes: DataFrame, path: str) -> None:
    """Distinct genes, sorted, as CSV."""
    genes.select("gene").distinct().orderBy("gene").coalesce(1).write.mode("overwrite").csv(path, header=True)
