"""Queries on embedding vectors and predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.functions import scalars
from tissueflow.operators import pseudobulk, qc, spatial, vectors
from tissueflow.plans.fixtures import Tables
from tissueflow.plans.registry import register

_queries = lambda t: t.raw("embeddings").filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
_keys = lambda t: t.raw("embeddings").filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("key_id"), "embedding")
_TOP = """WITH m AS (SELECT q.vec_id AS query_id, k.vec_id AS key_id, list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS similarity, list_distance(q.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS d, k.embedding AS x FROM embeddings q JOIN embeddings k ON q.vec_id % 5 = 0 AND k.vec_id % 5 <> 0),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, key_id) AS rank, CASE WHEN d = 0 THEN NULL ELSE 1 / (d * d) END AS weight FROM m QUALIFY rank <= 8)"""
_matches = lambda t: vectors.top_matches(_queries(t), _keys(t), 8)
register("j11_top_matches", _matches, "", f"{_TOP} SELECT query_id, key_id, round(similarity, 6) AS similarity, rank FROM top")


def _visited(t: Tables) -> DataFrame:
    """How many of the pairs of queries and balls of some 64 keys the search looks at."""
    report: dict[str, int] = {}
    vectors.top_matches(_queries(t), _keys(t), 8, block=64, report=report)
    return t.spark.createDataFrame([(report["pairs"], report["visited"])], "pairs long, visited long")


register("j11_visited_share", _visited)
_weights = lambda t: vectors.match_weights(_matches(t), _queries(t), _keys(t))
_key_values = lambda t: _keys(t).select("key_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("g")).select("key_id",
    F.concat(F.lit("G"), "g").alias("gene"), ((F.col("key_id") * 7 + F.col("g") * 3) % 11).cast("double").alias("value"))
register("j12_matched_expression", lambda t: vectors.average_matched_expression(_weights(t), _key_values(t)), "",
    f"{_TOP} SELECT query_id, concat('G', g) AS gene, round(sum(weight * ((key_id * 7 + g * 3) % 11)) / sum(weight), 6) AS value FROM top CROSS "
    f"JOIN (SELECT unnest(range(5)) AS g) GROUP BY query_id, g")
register("j12_matched_embedding", lambda t: vectors.average_matched_embedding(_weights(t)), "",
    f"{_TOP} SELECT query_id, CAST(place - 1 AS BIGINT) AS place, round(sum(weight * x[place]::DOUBLE) / sum(weight), 6) AS value FROM top CROSS "
    f"JOIN (SELECT unnest(range(1, 65)) AS place) GROUP BY query_id, place")
register("fn13_vectors", lambda t: t.raw("embeddings").select("vec_id", scalars.norm(F.col("embedding")).alias("norm"),
    scalars.unit(F.col("embedding"))[3].alias("third"), scalars.dot(F.col("embedding"), F.reverse("embedding")).alias("dot"),
    scalars.distance(F.col("embedding"), F.reverse("embedding")).alias("distance")), "",
    """SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[4] / sqrt(list_inner_product(e, e)), 6) AS third,
    round(list_inner_product(e, list_reverse(e)), 6) AS dot, round(list_distance(e, list_reverse(e)), 6) AS distance FROM (SELECT vec_id,
    embedding::DOUBLE[] AS e FROM embeddings)""")
register("fn11_one_hot", lambda t: t.raw("embeddings").select("vec_id",
    F.array_join(scalars.one_hot(F.col("label"), 10).cast("array<string>"), "").alias("code")), "",
    "SELECT vec_id, concat(repeat('0', label), '1', repeat('0', 9 - label)) AS code FROM embeddings")
register("j7_cell_information", lambda t: vectors.cell_information(t.cells.select("sample_id", "cell_idx", (F.col("x") * 2).alias("prediction")),
    t.cells).fillna("-", ["class"]), "cells", "SELECT sample_id, cell_idx, x * 2 AS prediction, barcode, CAST(label AS BIGINT) AS label, "
    "CASE label WHEN 0 THEN 'Connective' WHEN 1 THEN 'Dead' WHEN 2 THEN 'Epithelial' WHEN 3 THEN 'Inflammatory' WHEN 4 THEN 'Neoplastic' WHEN -1 THEN "
    "'Nolabel' ELSE '-' END AS class, x, y FROM cells")


def _bags(t: Tables) -> DataFrame:
    lists = spatial.spot_cell_lists(t.embedded)
    d = vectors.assemble_bags(lists, t.embedded.drop("spot_id"), qc.size_factors(t.expression, t.spots))
    total = F.aggregate("instances", F.lit(0.0), lambda a, x: a + x["embedding"][0].cast("double"))
    return d.select("sample_id", "spot_id", F.size("instances").alias("n"),
    F.array_join(F.transform("instances", lambda x: x["cell_idx"].cast("string")), ",").alias("cells"),
    F.array_join(F.transform("instances", lambda x: x["label"].cast("string")), ",").alias("labels"), total.alias("first"), "size_factor")


register("j16_bags", _bags, "embedded expression spots", """, s AS (SELECT s.sample_id, s.spot_id, coalesce(sum(count), 0) AS total FROM spots s LEFT
    JOIN expression e ON e.spot_id = s.spot_id GROUP BY ALL), f AS (SELECT *, total / median(total) OVER (PARTITION BY sample_id) AS size_factor FROM s)
    SELECT e.sample_id, e.spot_id, count(*) AS n, string_agg(CAST(cell_idx AS VARCHAR), ',' ORDER BY cell_idx) AS cells, string_agg(CAST(label AS VARCHAR),
    ',' ORDER BY cell_idx) AS labels, round(sum(embedding[1]::DOUBLE), 6) AS "first", round(any_value(size_factor), 6) AS size_factor FROM embedded e
    JOIN f ON f.spot_id = e.spot_id GROUP BY 1, 2""")

# a network of one layer has SQL for its forward pass
_ONE = [(np.array([[(k * 7 + j * 3) % 5 - 2 for j in range(64)] for k in range(3)]) / 4.0, np.array([0.1, -0.2, 0.3]))]
_PRED = """, w AS (SELECT k, j, ((k * 7 + j * 3) % 5 - 2) / 4.0::DOUBLE AS w FROM (SELECT unnest(range(3)) AS k) CROSS JOIN (SELECT unnest(range(64)) AS j)),
    z AS (SELECT e.cell_idx, e.sample_id, e.spot_id, k, sum(w * embedding[j + 1]::DOUBLE) + CASE k WHEN 0 THEN 0.1 WHEN 1 THEN -0.2 ELSE 0.3 END AS z FROM embedded e CROSS JOIN w GROUP BY e.cell_idx, e.sample_id, e.spot_id, k), p AS (SELECT *, concat('G', k) AS gene, CASE WHEN 20 * z > 20 THEN z ELSE ln(1 + exp(20 * z)) / 20 END AS value FROM z)"""
_predicted = lambda t: vectors.predict_cells(t.embedded, _ONE)
register("m3_predict_cells", lambda t: _predicted(t).select("cell_idx", *[F.col("prediction")[k].alias(f"p{k}") for k in range(3)]), "embedded",
    f"{_PRED} SELECT cell_idx, " + ", ".join(f"round(max(value) FILTER (k = {k}), 6) AS p{k}" for k in range(3)) + " FROM p GROUP BY 1")
register("a11_bag_means", lambda t: vectors.bag_means(_predicted(t), ["G0", "G1", "G2"]), "embedded",
    f"{_PRED} SELECT sample_id, spot_id, gene, round(avg(value), 6) AS value FROM p WHERE spot_id IS NOT NULL GROUP BY ALL")
register("a12_bag_nb_means", lambda t: vectors.bag_nb_means(vectors.bag_means(_predicted(t), ["G0", "G1", "G2"]), qc.size_factors(t.expression, t.spots)),
    "embedded expression spots", f"""{_PRED}, s AS (SELECT s.sample_id, s.spot_id, coalesce(sum(count), 0) AS total FROM spots s LEFT
    JOIN expression e ON e.spot_id = s.spot_id GROUP BY ALL), f AS (SELECT *, total / median(total) OVER (PARTITION BY sample_id) AS size_factor FROM s)
    SELECT p.sample_id, p.spot_id, gene, round(avg(value), 6) AS value, round(any_value(size_factor), 6) AS size_factor,
    round(avg(value) * any_value(size_factor), 6) AS mu FROM p JOIN f ON f.spot_id = p.spot_id GROUP BY 1, 2, 3""")

# a network of three layers, each activation against SQL; the k-th output of a layer of n inputs has weights ((k * 7 + j * 3 + n) % 5 - 2) / n
_SIZES = (64, 12, 8, 5)
_weight = lambda k, j, n: ((k * 7 + j * 3 + n) % 5 - 2) / n
_DEEP = [(np.array([[_weight(k, j, n) for j in range(n)] for k in range(m)]), np.array([(k % 3 - 1) / 10.0 for k in range(m)])) for n,
    m in zip(_SIZES, _SIZES[1:], strict=False)]


def _deep_sql(out: str) -> str:
    x = "embedding::DOUBLE[]"
    parts = []
    for i, (n, m) in enumerate(zip(_SIZES, _SIZES[1:], strict=False)):
        z = f"[list_sum([x[j + 1] * (((k * 7 + j * 3 + {n}) % 5 - 2) / {n}.0::DOUBLE) FOR j IN range({n})]) + (k % 3 - 1) / 10.0::DOUBLE FOR k IN range({m})]"
        z = z if m == _SIZES[-1] else f"[CASE WHEN v > 0 THEN v ELSE 0.01::DOUBLE * v END FOR v IN {z}]"
        parts.append(f"h{i + 1} AS (SELECT cell_idx, {z} AS x FROM {'(SELECT cell_idx, ' + x + ' AS x FROM embedded)' if i == 0 else f'h{i}'})")
    return f", {', '.join(parts)}, o AS (SELECT cell_idx, {out} AS y FROM h{len(parts)}) SELECT cell_idx, " + ", ".join(f"round(y[{k + 1}], "
    f"6) AS p{k}" for k in range(_SIZES[-1])) + " FROM o"


_ACTIVATIONS = {
    "relu": "[greatest(v, 0) FOR v IN x]",
    "softplus": "[CASE WHEN 20 * v > 20 THEN v ELSE ln(1 + exp(20 * v)) / 20 END FOR v IN x]",
    "sigmoid": "[1 / (1 + exp(-v)) FOR v IN x]",
    "softmax": "[exp(v) / list_sum([exp(u) FOR u IN x]) FOR v IN x]",
    "identity": "x",
}
for _name, _out in _ACTIVATIONS.items():
    register(f"m3_deep_{_name}", lambda t, a=_name: vectors.predict_cells(t.embedded, _DEEP, a).select("cell_idx",
    *[F.col("prediction")[k].alias(f"p{k}") for k in range(_SIZES[-1])]), "embedded", _deep_sql(_out))

# distances to fixed centres stand in for fitted ones where SQL has to follow
_DIST = "d AS (SELECT vec_id AS cell_idx, label AS cluster, c AS centre, list_distance(embedding::DOUBLE[], [CASE WHEN j % 10 = c THEN 0.5::DOUBLE ELSE 0 END FOR j IN range(64)]) AS distance FROM embeddings CROSS JOIN (SELECT unnest(range(10)) AS c))"


def _clustered(t: Tables) -> DataFrame:
    centres = F.array(*[F.array(*[F.lit(0.5 if j % 10 == c else 0.0) for j in range(64)]) for c in range(10)])
    return t.raw("embeddings").select(F.col("vec_id").alias("cell_idx"), F.col("label").alias("cluster"),
    F.transform(centres, lambda c: scalars.distance(F.col("embedding"), c)).alias("distances"))


register("w2_nearest_to_own_centre", lambda t: vectors.nearest_to_own_centre(_clustered(t), 7).select("cluster", "cell_idx", "distance", "rank"), "",
    f"WITH {_DIST} SELECT CAST(cluster AS BIGINT) AS cluster, cell_idx, round(distance, 6) AS distance, row_number() OVER (PARTITION BY cluster "
    f"ORDER BY distance, cell_idx) AS rank FROM d WHERE cluster = centre QUALIFY rank <= 7")
register("w3_nearest_to_each_centre", lambda t: vectors.nearest_to_each_centre(_clustered(t), 7), "",
    f"WITH {_DIST} SELECT cell_idx, centre, round(distance, 6) AS distance, row_number() OVER (PARTITION BY centre ORDER BY distance, cell_idx) AS rank "
    f"FROM d QUALIFY rank <= 7")
register("a16_cluster_counts", lambda t: vectors.cluster_counts(t.cells.select("sample_id", (F.col("cell_idx") % 6).alias("cluster"),
    F.coalesce(scalars.class_name(F.col("label")), F.lit("-")).alias("class"))), "cells",
    "SELECT cell_idx % 6 AS cluster, CASE label WHEN 0 THEN 'Connective' WHEN 1 THEN 'Dead' WHEN 2 THEN 'Epithelial' WHEN 3 THEN 'Inflammatory' WHEN 4 THEN "
    "'Neoplastic' WHEN -1 THEN 'Nolabel' ELSE '-' END AS class, sample_id, count(*) AS n FROM cells GROUP BY ALL")
register("m1_cluster_embeddings", lambda t: vectors.cluster_embeddings(t.raw("embeddings"), 6, 50).select("vec_id", "cluster",
    F.array_min("distances").alias("least")))
register("m2_medoid_types", lambda t: t.ref_cells.filter(F.col("cell_type").isin(*vectors.medoid_types(pseudobulk.pseudobulk(t.ref_expression,
    t.ref_cells.withColumn("sample_id", F.col("cell_type")), mode="mean").withColumnRenamed("sample_id", "cell_type"),
    3))).groupBy("cell_type").agg(F.count("*").alias("n")))


def _images(t: Tables) -> DataFrame:
    """72 x 72 x 3 bytes for each vector: the 32 of its id's hash, again and again."""
    pixel = F.unhex(F.repeat(F.sha2(F.col("vec_id").cast("string"), 256), 72 * 72 * 3 // 32))
    return t.raw("embeddings").select(F.concat(F.lit("S"), F.col("label").cast("string")).alias("sample_id"), F.col("vec_id").alias("cell_idx"),
    pixel.alias("img"))


# in SQL a byte of the hash counts as often as it falls into the middle of the patch
_PIXELS = """WITH img AS (SELECT vec_id, label, [CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS INTEGER) FOR i IN range(32)] AS b FROM (SELECT *, sha256(CAST(vec_id AS VARCHAR)) AS h FROM embeddings)),
    pos AS (SELECT c, ((r * 72 + k) * 3 + c) % 32 AS i, count(*) AS m FROM (SELECT unnest(range(12, 60)) AS r) CROSS JOIN (SELECT unnest(range(12, 60)) AS k) CROSS JOIN (SELECT unnest(range(3)) AS c) GROUP BY 1, 2),
    px AS (SELECT vec_id, concat('S', CAST(label AS VARCHAR)) AS sample_id, c, m, i, b[i + 1] AS v FROM img CROSS JOIN pos)"""
register("a5_patch_statistics", lambda t: vectors.patch_statistics(_images(t)).select("sample_id",
    *[F.col(c)[k].alias(f"{c}{k}") for c in ("mean", "std") for k in range(3)]), "", f"""{_PIXELS},
    one AS (SELECT vec_id, sample_id, c, sum(m * v) / 2304 / 255.0::DOUBLE AS mean,
    sqrt((sum(m * v * v) - sum(m * v) * sum(m * v) / 2304.0::DOUBLE) / 2303) / 255 AS std FROM px GROUP BY ALL)
    SELECT sample_id, """ + ", ".join(f"round(avg({what}) FILTER (c = {k}), 6) AS {what}{k}" for what in ("mean", "std") for k in range(3)) + " FROM one "
    "GROUP BY 1")
_pixels = lambda f: F.aggregate("pixels", F.lit(0.0), lambda a, x: a + f(x.cast("double")))
register("fn10_normalised_patches", lambda t: vectors.normalised_patches(_images(t), (0.5, 0.4, 0.3), (0.2, 0.2, 0.2)).select("sample_id", "cell_idx",
    F.size("pixels").alias("n"), F.col("pixels")[0].alias("first"), _pixels(lambda x: x).alias("total"), _pixels(lambda x: x * x).alias("squares"),
    F.array_min("pixels").alias("least"), F.array_max("pixels").alias("most")), "", f"""{_PIXELS},
    f AS (SELECT *, CAST(CAST((v / 255.0::DOUBLE - (0.5::DOUBLE - c * 0.1::DOUBLE)) / 0.2::DOUBLE AS FLOAT) AS DOUBLE) AS x FROM px)
    SELECT sample_id, vec_id AS cell_idx, CAST(sum(m) AS BIGINT) AS n, round(any_value(x) FILTER (c = 0 AND i = ((12 * 72 + 12) * 3) % 32), 6) AS "first",
    round(sum(m * x), 6) AS total, round(sum(m * x * x), 6) AS squares, round(min(x), 6) AS least, round(max(x), 6) AS most FROM f GROUP BY 1, 2""")
