"""From documents to token shards: each stage reads what the one before it kept.

language ID -> near-duplicates -> decontamination -> mixing -> token output. All but the last return the columns
of documents. Nothing here swallows an import error.

Defined results: a null or empty text, or one without a letter, is rejected by language ID; rows without doc_id are compared with no others
for copies and stay; of a group of near copies the smallest doc_id stays, of rows alike in doc_id and text one row, by a hash of its other columns; rows of
one doc_id with other texts are documents of their own; a null source is a source, the last one; ties of the mix are broken by a hash of doc_id and
text; an empty table gives an empty result; further columns come back from all stages but the last with their names and values, whatever
they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tissueflow.llm.common import dropped, written
from tissueflow.llm.decontamination import clean
from tissueflow.llm.langid import accepted, training_text
from tissueflow.llm.mixing import repeated
from tissueflow.llm.neardup import deduplicated
from tissueflow.llm.token_output import token_output


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold no letter or read as none of the labelled languages."""
    return accepted(docs, training_text(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    return deduplicated(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids written as wavelet-matrix shards, and what the files say of each document."""
    import public_tokenizers

    return token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", tokens),
]
#: Similarity components and models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
