"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import token_output

    return token_output(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, secrets

    return digest(secrets(_documents(spark, sf_dir)))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licenses

    return licenses(_documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "times", "source")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import without_repeats

    return without_repeats(_documents(spark, sf_dir)).drop("kept")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), size=3, percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out
    from .toxicity import THRESHOLD, toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity(_documents(spark, sf_dir), labels.filter(~held_out(F.col("doc_id"), 3, 1)))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, predicted, training_text

    docs = _documents(spark, sf_dir)
    texts = training_text(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    return predicted(docs.select("doc_id", "text"), texts).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import ranked

    return ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import without_repeated_lines

    return without_repeated_lines(_documents(spark, sf_dir)).drop("kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hardneg import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label)


QUERIES = {f.__name__: f for f in (op1_token_output, op2_substring_dedup, op3_near_duplicates, op4_decontamination, op5_secrets, op6_toxicity, op7_language_id, op8_nearest_neighbours, op9_licenses, op10_mixing, op11_ranked_search, op12_line_dedup, op13_hard_negatives)}
ORACLE: dict[str, str] = {"op2_substring_dedup": oracles.OP2, "op3_near_duplicates": oracles.OP3, "op5_secrets": oracles.OP5, "op9_licenses": oracles.OP9, "op11_ranked_search": oracles.OP11, "op12_line_dedup": oracles.OP12, "op13_hard_negatives": oracles.OP13}
