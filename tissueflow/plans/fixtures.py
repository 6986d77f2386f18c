"""The library's input tables, made from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tissueflow.sources.store import written

_LINES = "(SELECT *, least(l_partkey % 200, (l_partkey * 7 + l_suppkey * 13 + l_linenumber * 31) % 200) AS g FROM {lineitem})"
_GENE = "concat(CASE WHEN g < 5 THEN 'MT-G' ELSE 'G' END, CAST(g AS STRING))"
_THREE = "(SELECT 'SA' AS sample_id UNION ALL SELECT 'SN' UNION ALL SELECT 'SR')"
_SAMPLE = "CASE WHEN {k} % 3 = 0 THEN 'SA' WHEN {k} % 3 = 1 THEN 'SN' ELSE 'SR' END"


def _sample(k: str) -> str:
    return _SAMPLE.replace("{k}", k)


#: All genes that expression can have.
GENES = [f"MT-G{k}" if k < 5 else f"G{k}" for k in range(200)]
#: Later ones may use earlier ones by name.
TABLES = {
    "transcripts": f"""SELECT concat('S', l_returnflag) AS sample_id,
        CASE WHEN l_linenumber = 7 THEN 'UNASSIGNED' ELSE concat('c', CAST(l_orderkey % 2000 AS STRING)) END AS cell_id,
        concat(CASE WHEN g < 5 THEN 'MT-G' WHEN g < 8 THEN 'BLANK_G' WHEN g < 11 THEN 'NegControlProbe_G' WHEN g < 13 THEN 'antisense_G' ELSE 'G' END,
        CAST(g AS STRING)) AS feature_name,
        l_quantity AS qv FROM {_LINES} t""",
    "expression": f"""SELECT sample_id, concat('s', CAST(spot_pos AS STRING), '_', sample_id) AS spot_id, spot_pos, gene, count
        FROM (SELECT concat('S', l_returnflag) AS sample_id, l_orderkey % 500 AS spot_pos, {_GENE} AS gene, sum(l_quantity) AS count FROM {_LINES} t
        GROUP BY 1, 2, 3) e""",
    "spots": f"""SELECT sample_id, concat('s', CAST(p AS STRING), '_', sample_id) AS spot_id, p AS spot_pos,
        CAST(floor(p / 25.0) AS INT) AS array_row, CAST(2 * (p % 25) + floor(p / 25.0) % 2 AS INT) AS array_col,
        CAST((2 * (p % 25) + floor(p / 25.0) % 2) * 50 AS DOUBLE) AS x, CAST(floor(p / 25.0) * 87 AS DOUBLE) AS y
        FROM (SELECT DISTINCT l_orderkey % 500 AS p FROM {{lineitem}}) t CROSS JOIN {_THREE} s""",
    "cells": f"""SELECT {_sample("o_orderkey")} AS sample_id, o_orderkey AS cell_idx, concat('b', CAST(o_orderkey AS STRING)) AS barcode,
        CAST((o_orderkey * 7919) % 2500 AS DOUBLE) AS x, CAST((o_orderkey * 104729) % 1740 AS DOUBLE) AS y, CAST(o_custkey % 7 AS INT) - 1 AS label
        FROM {{orders}}""",
    "segmented": f"""SELECT sample_id, concat('c', CAST(k AS STRING)) AS cell_id, (k * 7919) % 2500 + CAST(0.7 AS DOUBLE) AS x,
    (k * 104729) % 1740 + CAST(0.2 AS DOUBLE) AS y
        FROM (SELECT DISTINCT o_orderkey % 2500 AS k FROM {{orders}}) t CROSS JOIN {_THREE} s WHERE k % 7 <> 0""",
    "slide_meta": f"""SELECT sample_id, CAST(0.5 AS DOUBLE) AS pixel_size, CAST(55.0 AS DOUBLE) AS spot_diameter, 2400 AS width, 1700 AS height
    FROM {_THREE} s""",
    "ref_cells": """SELECT DISTINCT concat('r', CAST(l_orderkey % 2000 AS STRING)) AS cell_id, concat('t', CAST(l_orderkey % 2000 % 8 AS STRING)) AS cell_type,
        concat('S', CAST(l_orderkey % 2000 % 3 AS STRING)) AS sample_id, concat('v', CAST(l_orderkey % 2000 % 5 AS STRING)) AS tissue FROM {lineitem}""",
    "ref_expression": f"""SELECT concat('r', CAST(l_orderkey % 2000 AS STRING)) AS cell_id, {_GENE} AS gene, sum(l_quantity) AS count FROM {_LINES} t
    GROUP BY 1, 2""",
    "bulk_cells": """SELECT DISTINCT concat('u', CAST(l_suppkey AS STRING)) AS cell_id, concat('S', CAST(l_suppkey % 4 AS STRING)) AS sample_id
    FROM {lineitem}""",
    "bulk_expression": f"""SELECT concat('u', CAST(l_suppkey AS STRING)) AS cell_id, {_GENE} AS gene, sum(l_quantity) AS count FROM (SELECT *,
    least(l_orderkey % 200, (l_partkey * 7 + l_linenumber * 31) % 200) AS g FROM {{lineitem}}) t GROUP BY 1, 2""",
    "samples": """SELECT CAST(doc_id AS STRING) AS id, CASE WHEN lang = 'en' THEN 'Homo sapiens' ELSE lang END AS species,
    CASE WHEN doc_id % 4 = 0 THEN 'Visium' WHEN doc_id % 4 = 1 THEN 'Xenium' ELSE source END AS st_technology,
        CASE WHEN doc_id % 3 = 0 THEN 'FFPE' ELSE 'Fresh Frozen' END AS preservation_method,
        CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN concat('block ffpe, "', source, '"') ELSE source END AS subseries,
        concat('o', CAST(doc_id % 6 AS STRING)) AS organ FROM {documents}""",
    "samples_of_texts": """SELECT CAST(doc_id AS STRING) AS id, CASE WHEN lang = 'en' THEN 'Homo sapiens' ELSE lang END AS species,
    CASE WHEN doc_id % 4 = 0 THEN 'Visium' WHEN doc_id % 4 = 1 THEN 'Xenium' ELSE source END AS st_technology,
        CASE WHEN doc_id % 3 = 0 THEN 'FFPE' ELSE 'Fresh Frozen' END AS preservation_method,
        CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN concat(text, ' Ffpe block') ELSE text END AS subseries,
        concat('o', CAST(doc_id % 6 AS STRING)) AS organ FROM {documents}""",
    "signature": """SELECT concat('G', CAST(p_partkey AS STRING)) AS gene,
    CASE WHEN p_size % 6 = 0 THEN 'Connective' WHEN p_size % 6 = 1 THEN 'Dead' WHEN p_size % 6 = 2 THEN 'Epithelial' WHEN p_size % 6 = 3 THEN 'Inflammatory'
    ELSE 'Neoplastic' END AS celltype
        FROM {part} WHERE p_partkey % 3 = 0""",
    "gene_list": "SELECT concat('G', CAST(p_partkey AS STRING)) AS gene FROM {part} WHERE p_partkey % 4 = 0 UNION ALL SELECT concat('G', "
    "CAST(p_partkey AS STRING)) FROM {part} WHERE p_partkey % 8 = 0",
    "truth": """SELECT sample_id, spot_id, spot_pos, gene, ln(1 + count * 10000 / (sum(count) OVER (PARTITION BY spot_id))) AS value FROM [expression] e""",
    "pred": """SELECT sample_id, spot_id, gene, CAST(0.7 AS DOUBLE) * value + CAST((spot_pos * 31 + length(gene) * 17) % 10 AS DOUBLE) / CAST(10 AS DOUBLE)
    AS value FROM [truth] t WHERE gene <> 'G20'""",
    "embedded": f"""SELECT {_sample("vec_id")} AS sample_id, vec_id AS cell_idx, embedding, label, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE concat('s',
    CAST(vec_id % 40 AS STRING), '_', {_sample("vec_id")}) END AS spot_id FROM {{embeddings}}""",
}


def _text(name: str, braces: bool) -> str:
    text = re.sub(r"\[(\w+)\]", lambda m: f"({_text(m[1], braces)})", TABLES[name])
    return text if braces else re.sub(r"\{(\w+)\}", r"\1", text)


def duckdb_with(*names: str) -> str:
    """WITH clause of these tables for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({_text(n, False)})" for n in names)


class Tables:
    """The driver's tables and those made from them, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._stored = spark, sf_dir, {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        text = _text(name, True)
        return self.spark.sql(text, **{n: self.raw(n) for n in set(re.findall(r"\{(\w+)\}", text))})

    def stored(self, name: str) -> DataFrame:
        """The table written once, for jobs that pass over it several times (their real inputs are stored tables)."""
        if name not in self._stored:
            self._stored[name] = written(getattr(self, name), name)
        return self._stored[name]

    @cached_property
    def genes20(self) -> list[str]:
        return [f"G{k}" for k in range(13, 33)]
