"""Choosing samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_samples(samples: DataFrame, organ: str, species: str = "Homo sapiens", technologies: Sequence[str] = ("Visium", "Xenium"), preservation: str = "FFPE") -> DataFrame:
    """Samples of one organ, species and technology that are preserved so, or whose subseries says so (null: no)."""
    preserved = (F.col("preservation_method") == preservation) | F.coalesce(F.col("subseries").ilike(f"%{preservation}%"), F.lit(False))
    return samples.filter((F.col("species") == species) & F.col("st_technology").isin(*technologies) & preserved & (F.col("organ") == organ))


def pick_samples(samples: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The samples with these ids, in this order (column pos); an unknown id is an error."""
    wanted = samples.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    missing = [r["id"] for r in wanted.join(samples, "id", "left_anti").select("id").collect()]
    if missing:
        raise KeyError(f"no such samples: {sorted(missing)}")
    return wanted.join(samples, "id").orderBy("pos")


def common_radius(slide_meta: DataFrame) -> int:
    """Half the spot diameter (whole) that all samples share; differing ones are an error."""
    found = slide_meta.select(F.floor(F.floor("spot_diameter") / 2).cast("int").alias("r")).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("samples have no radius in common" if found else "no samples")
    return found[0]["r"]


def leave_one_out(df: DataFrame, ids: Sequence[str], fold: int, key: str = "sample_id") -> DataFrame:
    """All samples but ids[fold]; fold -1 keeps all."""
    return df if fold == -1 else df.filter(F.col(key) != ids[fold])
