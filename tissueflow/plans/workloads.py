"""Whole workloads: training bags from cells and spots, and prediction to score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.operators import metrics, qc, spatial, vectors
from tissueflow.plans.fixtures import Tables
from tissueflow.plans.matrix import _G
from tissueflow.plans.places import _hit
from tissueflow.plans.registry import register
from tissueflow.plans.vectors import _ONE, _PRED
from tissueflow.sources.store import written


def training_bags(t: Tables) -> DataFrame:
    """Scaled expression of the panel in every spot that has counts and cells, with its number of cells."""
    prepared = written(qc.log_normalised(qc.VISIUM.prepare(t.stored("expression"), t.spots)), "prepared")
    # the smallest tables leave no gene, which is an empty result here and not an error
    measured = prepared.join(t.signature.select("gene").distinct(), "gene", "left_semi")
    panel = measured.groupBy("gene").agg(F.count_distinct("sample_id").alias("n")).filter("n = 3").select("gene")
    bags = spatial.bags(prepared, spatial.radius_join(t.cells, t.spots, 40)).select("sample_id", "spot_id", F.size("cells").alias("n_cells"))
    dense = qc.densify(prepared, bags, panel)
    return qc.robust_scale(dense).join(bags, ["sample_id", "spot_id"])


register("wl2_training_bags", training_bags, "expression spots cells signature",
    f"""{_G}, {_hit(40)}, l AS (SELECT *, ln(1 + count * 10000 / sum(count) OVER (PARTITION BY spot_id)) AS value FROM prepared),
    panel AS (SELECT gene FROM l WHERE gene IN (SELECT gene FROM signature) GROUP BY 1 HAVING count(DISTINCT sample_id) = 3),
    bags AS (SELECT sample_id, spot_id, count(*) AS n_cells FROM assigned WHERE spot_id IN (SELECT spot_id FROM l) GROUP BY 1, 2),
    dense AS (SELECT b.*, p.gene, coalesce(value, 0) AS value FROM bags b CROSS JOIN panel p LEFT JOIN l ON l.spot_id = b.spot_id AND l.gene = p.gene),
    r AS (SELECT gene, quantile_cont(value, 0.95) - min(value) AS r FROM dense GROUP BY 1)
    SELECT sample_id, spot_id, n_cells, gene, round(value / CASE WHEN r = 0 THEN 1 ELSE r END, 6) AS value FROM dense JOIN r USING (gene)""")


def predict_and_score(t: Tables) -> DataFrame:
    """Cells to predictions to bag means, scored by gene against measured expression."""
    names = ["G20", "G21", "G22"]
    bags = written(vectors.bag_means(vectors.predict_cells(t.embedded, _ONE), names), "bag-means")
    truth = qc.log_normalised(t.stored("expression"))
    return metrics.regression_metrics(metrics.align(truth, bags, bags.select("spot_id").distinct()))


register("wl3_predict_and_score", predict_and_score, "embedded expression",
    f"""{_PRED}, bags AS (SELECT spot_id, concat('G', k + 20) AS gene, avg(value) AS p FROM p WHERE spot_id IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT *, ln(1 + count * 10000 / sum(count) OVER (PARTITION BY spot_id)) AS value FROM expression),
    a AS (SELECT b.gene, coalesce(value, 0) AS y, p FROM bags b LEFT JOIN l ON l.spot_id = b.spot_id AND l.gene = b.gene),
    r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY y) + (count(*) OVER (PARTITION BY gene, y) - 1) / 2.0::DOUBLE AS ry,
    rank() OVER (PARTITION BY gene ORDER BY p) + (count(*) OVER (PARTITION BY gene, p) - 1) / 2.0::DOUBLE AS rp FROM a)
    SELECT gene, round(corr(y, p), 6) AS pcc, round(corr(ry, rp), 6) AS scc, round(avg((y - p) * (y - p)), 6) AS mse FROM r GROUP BY 1""")
