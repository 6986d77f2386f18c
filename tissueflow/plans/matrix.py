"""Queries on transcripts, counts, quality control and pseudobulk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tissueflow.operators import aggregates, counts, pseudobulk, qc
from tissueflow.plans.registry import register
from tissueflow.sources.store import written

_KEPT = "kept AS (SELECT * FROM transcripts WHERE cell_id <> 'UNASSIGNED' AND qv > 20)"
_COUNTS = _KEPT + ", counts AS (SELECT sample_id, cell_id, feature_name AS gene, CAST(count(*) AS DOUBLE) AS count FROM kept GROUP BY ALL)"
_ALIGNED = _COUNTS + ", aligned AS (SELECT c.* FROM counts c SEMI JOIN segmented s ON c.sample_id = s.sample_id AND c.cell_id = s.cell_id)"


def _counts(t):
    return counts.count_transcripts(counts.quality_transcripts(t.transcripts))


def _cell_by_gene(t):
    d = qc.filter_cell_genes(written(counts.align_counts(_counts(t), t.segmented), "aligned-counts"))
    return qc.log1p(qc.normalise_total(d, keys=counts.CELL)).select("sample_id", "cell_id", "gene", "count", "value")


register("wl1_cell_by_gene", _cell_by_gene, "transcripts segmented", f""", {_ALIGNED},
    ok AS (SELECT sample_id, gene FROM aligned GROUP BY ALL HAVING count(*) FILTER (count > 0) >= 5), d AS (SELECT a.* FROM aligned a SEMI
    JOIN ok ON a.sample_id = ok.sample_id AND a.gene = ok.gene)
    SELECT sample_id, cell_id, gene, count, round(ln(1 + count * 10000 / sum(count) OVER (PARTITION BY sample_id, cell_id)), 6) AS value FROM d""")
register("f3_quality_transcripts", lambda t: counts.quality_transcripts(t.transcripts), "transcripts",
    "SELECT * FROM transcripts WHERE cell_id <> 'UNASSIGNED' AND qv > 20")
register("f3_quality_report", lambda t: counts.quality_report(t.transcripts), "transcripts",
    """SELECT sample_id, count(*) AS n_transcripts, count(*) FILTER (cell_id <> 'UNASSIGNED' AND qv > 20) AS n_kept,
    round(100.0::DOUBLE * count(*) FILTER (cell_id <> 'UNASSIGNED' AND qv > 20) / count(*), 6) AS percent_kept,
    count(DISTINCT CASE WHEN cell_id <> 'UNASSIGNED' AND qv > 20 THEN cell_id END) AS n_cells FROM transcripts GROUP BY 1""")
register("a1_transcript_counts", _counts, "transcripts", f", {_COUNTS} SELECT * FROM counts")
register("j4_aligned_counts", lambda t: counts.align_counts(_counts(t), t.segmented), "transcripts segmented", f", {_ALIGNED} SELECT * FROM aligned")
register("u4_cells_without_transcripts", lambda t: counts.cells_without_transcripts(t.segmented, _counts(t)), "transcripts segmented",
    f", {_COUNTS} SELECT sample_id, cell_id FROM segmented s ANTI JOIN counts c ON c.sample_id = s.sample_id AND c.cell_id = s.cell_id")
register("u4_overlap_report", lambda t: counts.overlap_report(t.segmented, _counts(t)), "transcripts segmented",
    f""", {_COUNTS}, h AS (SELECT DISTINCT sample_id, cell_id, 1 AS has FROM counts)
    SELECT s.sample_id, count(*) AS n_cells, count(has) AS n_with, count(*) - count(has) AS n_without FROM segmented s LEFT
    JOIN h ON h.sample_id = s.sample_id AND h.cell_id = s.cell_id GROUP BY 1""")
register("j5_centroids", lambda t: counts.attach_centroids(counts.align_counts(_counts(t), t.segmented).select(*counts.CELL).distinct(), t.segmented),
    "transcripts segmented",
    f", {_ALIGNED} SELECT sample_id, cell_id, CAST(trunc(x) AS BIGINT) AS x, CAST(trunc(y) AS BIGINT) AS y FROM (SELECT DISTINCT sample_id, cell_id "
    f"FROM aligned) JOIN segmented USING (sample_id, cell_id)")

# quality control of spots, in the order of the workload
_G = """, g AS (SELECT sample_id, gene, sum(count) AS total, count(*) FILTER (count > 0) AS seen FROM expression GROUP BY ALL), n AS (SELECT sample_id, count(*) AS n FROM spots GROUP BY 1),
    f5 AS (SELECT e.* FROM expression e SEMI JOIN (SELECT g.sample_id, gene FROM g JOIN n ON g.sample_id = n.sample_id WHERE total >= 200 AND seen >= n // 10) k ON e.sample_id = k.sample_id AND e.gene = k.gene),
    f6 AS (SELECT f5.* FROM f5 SEMI JOIN (SELECT spot_id FROM f5 GROUP BY 1 HAVING sum(count) >= 20) k ON f5.spot_id = k.spot_id), prepared AS (SELECT * FROM f6 WHERE NOT starts_with(gene, 'MT-'))"""
#: Written, as what follows passes over it again.
_prepared = lambda t: written(_unwritten(t), "prepared")
_unwritten = lambda t: qc.VISIUM.prepare(t.stored("expression"), t.spots)
register("f5_filter_genes", lambda t: qc.filter_genes(t.stored("expression"), t.spots), "expression spots", f"{_G} SELECT * FROM f5")
register("f6_filter_spots", lambda t: qc.filter_spots(qc.filter_genes(t.stored("expression"), t.spots)), "expression spots", f"{_G} SELECT * FROM f6")
register("f7_filter_cell_genes", lambda t: qc.filter_cell_genes(_counts(t)), "transcripts",
    f", {_COUNTS} SELECT c.* FROM counts c SEMI JOIN (SELECT sample_id, gene FROM counts GROUP BY ALL "
    f"HAVING count(*) >= 5) k ON c.sample_id = k.sample_id AND c.gene = k.gene")
register("f8_without_mitochondrial", lambda t: qc.without_mitochondrial(t.expression), "expression", "SELECT * FROM expression WHERE gene NOT LIKE 'MT-%'")
register("f9_without_controls", lambda t: qc.without_controls(t.transcripts, "feature_name"), "transcripts",
    "SELECT * FROM transcripts WHERE NOT regexp_matches(feature_name, '^(BLANK_|NegControlCodeword_|NegControlProbe_|antisense_)')")
register("f10_reference_qc", lambda t: qc.reference_qc(t.stored("ref_expression"), 25, 300), "ref_expression",
    """, c AS (SELECT * FROM ref_expression WHERE cell_id IN (SELECT cell_id FROM ref_expression GROUP BY 1 HAVING count(*) FILTER (count > 0) >= 25))
    SELECT * FROM c WHERE gene IN (SELECT gene FROM c GROUP BY 1 HAVING sum(count) >= 300)""")
register("f11_keep_values", lambda t: qc.keep_values(t.ref_cells, "tissue", ["v1", "v3"]), "ref_cells", "SELECT * FROM ref_cells WHERE tissue IN ('v1', 'v3')")
register("f13_count_report", lambda t: qc.count_report(t.expression), "expression",
    "SELECT count(*) FILTER (isnan(count) OR isinf(count)) AS n_not_finite, min(count) AS least, sum(count) AS total, sum(count) % 1 AS fraction "
    "FROM expression")
register("x2_visium_handler", _unwritten, "expression spots", f"{_G} SELECT * FROM prepared")
register("x2_xenium_handler", lambda t: qc.TECHNOLOGIES["Xenium"].prepare(t.expression, t.spots), "expression",
    "SELECT * FROM expression e SEMI JOIN (SELECT sample_id, gene FROM expression GROUP BY ALL "
    "HAVING count(*) FILTER (count > 0) >= 5) k ON e.sample_id = k.sample_id AND e.gene = k.gene WHERE NOT starts_with(gene, 'MT-')")
_A4 = """, t AS (SELECT s.sample_id, s.spot_id, coalesce(sum(count), 0) AS total FROM spots s LEFT JOIN prepared p ON p.spot_id = s.spot_id GROUP BY ALL),
    factors AS (SELECT *, median(total) OVER (PARTITION BY sample_id) AS median_total, total / median(total) OVER (PARTITION BY sample_id) AS size_factor FROM t)"""
register("a4_size_factors", lambda t: qc.size_factors(_prepared(t), t.spots), "expression spots",
    f"{_G}{_A4} SELECT sample_id, spot_id, total, round(median_total, 6) AS median_total, round(size_factor, 6) AS size_factor FROM factors")
register("fn5_normalise_total", lambda t: qc.normalise_total(_prepared(t)), "expression spots",
    f"{_G} SELECT *, round(count * 10000 / sum(count) OVER (PARTITION BY spot_id), 6) AS value FROM prepared")
register("fn6_normalise_median", lambda t: qc.log1p(qc.normalise_median(t.stored("ref_expression"))), "ref_expression",
    """, s AS (SELECT cell_id, sum(count) AS total FROM ref_expression GROUP BY 1), m AS (SELECT median(total) AS m FROM s WHERE total <> 0)
    SELECT r.*, round(ln(1 + count * m / total), 6) AS value FROM ref_expression r JOIN s USING (cell_id) CROSS JOIN m""")
register("fn7_log1p", lambda t: qc.log_normalised(_prepared(t)), "expression spots",
    f"{_G} SELECT *, round(ln(1 + count * 10000 / sum(count) OVER (PARTITION BY spot_id)), 6) AS value FROM prepared")
register("fn16_log10", lambda t: qc.log10_normalised(t.expression), "expression",
    "SELECT *, round(log10(1 + count * 10000 / sum(count) OVER (PARTITION BY spot_id)), 6) AS value FROM expression")
_DENSE = f"""{_G}, l AS (SELECT *, ln(1 + count * 10000 / sum(count) OVER (PARTITION BY spot_id)) AS value FROM prepared), genes AS (SELECT DISTINCT gene
    FROM signature WHERE gene IN (SELECT gene FROM prepared)),
    dense AS (SELECT s.sample_id, s.spot_id, g.gene, coalesce(value, 0) AS value FROM spots s CROSS JOIN genes g LEFT
    JOIN l ON l.spot_id = s.spot_id AND l.gene = g.gene)"""
_dense = lambda t: qc.densify(qc.log_normalised(_prepared(t)), t.spots, t.signature)


def _scaled(t, mode):
    """Scaling is by gene, so only the panel's genes are kept once the spots' totals are known."""
    values = qc.log_normalised(_prepared(t)).join(t.signature.select("gene").distinct(), "gene", "left_semi")
    values = written(values, "log-normalised")
    return qc.densify(qc.robust_scale(values, mode, obs=t.spots), t.spots, t.signature)


register("j17_densify", _dense, "expression spots signature", f"{_DENSE} SELECT sample_id, spot_id, gene, round(value, 6) AS value FROM dense")
for _mode, _by in (("global_scaling", "gene"), ("slide_scaling", "sample_id, gene")):
    register(f"fn8_{_mode}", lambda t, m=_mode: _scaled(t, m), "expression spots signature",
    f"""{_DENSE}, r AS (SELECT {_by}, quantile_cont(value, 0.95) - min(value) AS r FROM dense GROUP BY {_by})
        SELECT d.sample_id, spot_id, d.gene, round(value / CASE WHEN r = 0 THEN 1 ELSE r END, 6) AS value FROM dense d JOIN r USING ({_by})""")

# pseudobulk: a reference cell's total is some thousands here, so limits are set to bite
_PB = """, x AS (SELECT c.sample_id, c.cell_type, e.* FROM ref_expression e JOIN ref_cells c USING (cell_id)),
    st AS (SELECT c.sample_id, c.cell_type, count(*) AS n_cells, coalesce(sum(t), 0) AS counts FROM ref_cells c LEFT JOIN (SELECT cell_id, sum(count) AS t FROM ref_expression GROUP BY 1) USING (cell_id) GROUP BY ALL HAVING count(*) >= 83 AND coalesce(sum(t), 0) >= 1000)"""
_pb = lambda t, mode: pseudobulk.pseudobulk(t.stored("ref_expression"), t.ref_cells, groups="cell_type", mode=mode, min_cells=83)
register("a8_pseudobulk_sum", lambda t: _pb(t, "sum"), "ref_cells ref_expression",
    f"{_PB} SELECT sample_id, cell_type, gene, sum(count) AS value, round(count(*) / n_cells::DOUBLE, 6) AS prop, n_cells, counts FROM x "
    f"JOIN st USING (sample_id, cell_type) GROUP BY sample_id, cell_type, gene, n_cells, counts")
register("a8_pseudobulk_mean", lambda t: _pb(t, "mean"), "ref_cells ref_expression",
    f"{_PB} SELECT sample_id, cell_type, gene, round(sum(count) / n_cells, 6) AS value, round(count(*) / n_cells::DOUBLE, 6) AS prop, n_cells, counts FROM x "
    f"JOIN st USING (sample_id, cell_type) GROUP BY sample_id, cell_type, gene, n_cells, counts")
register("a8b_pseudobulk_median", lambda t: pseudobulk.pseudobulk(t.stored("bulk_expression"), t.bulk_cells, mode="median", min_cells=1, min_counts=1), "bulk_cells bulk_expression", """,
    every AS (SELECT c.sample_id, c.cell_id, g.gene, coalesce(count, 0) AS count FROM bulk_cells c CROSS JOIN (SELECT DISTINCT gene FROM bulk_expression) g
    LEFT JOIN bulk_expression e ON e.cell_id = c.cell_id AND e.gene = g.gene),
    st AS (SELECT sample_id, count(DISTINCT cell_id) AS n_cells, sum(count) AS counts FROM every GROUP BY 1)
    SELECT sample_id, gene, round(median(count), 6) AS value, round(count(*) FILTER (count <> 0) / n_cells::DOUBLE, 6) AS prop, n_cells, counts FROM every
    JOIN st USING (sample_id) GROUP BY sample_id, gene, n_cells, counts HAVING median(count) <> 0""")
register("a8_pseudobulk_by_sample", lambda t: pseudobulk.pseudobulk(t.stored("ref_expression"), t.ref_cells), "ref_cells ref_expression",
    """, st AS (SELECT c.sample_id, count(*) AS n_cells, sum(t) AS counts FROM ref_cells c LEFT JOIN (SELECT cell_id, sum(count) AS t FROM ref_expression
    GROUP BY 1) USING (cell_id) GROUP BY ALL HAVING count(*) >= 10 AND sum(t) >= 1000)
    SELECT sample_id, gene, sum(count) AS value, round(count(*) / n_cells::DOUBLE, 6) AS prop, n_cells, counts FROM ref_expression
    JOIN ref_cells USING (cell_id) JOIN st USING (sample_id) GROUP BY sample_id, gene, n_cells, counts""")
register("a8c_x1_user_aggregates", lambda t: pseudobulk.pseudobulk_with(t.stored("ref_expression"), t.ref_cells, ["cell_type"],
    {"spread": aggregates.Spread(), "mean": aggregates.Moments()}), "ref_cells ref_expression",
    """, st AS (SELECT cell_type, count(*) AS n FROM ref_cells GROUP BY 1)
    SELECT cell_type, gene, max(count) - CASE WHEN count(*) = n THEN min(count) ELSE 0 END AS spread, round(sum(count) / n, 6) AS mean FROM ref_expression
    JOIN ref_cells USING (cell_id) JOIN st USING (cell_type) GROUP BY cell_type, gene, n""")
_noted = lambda t: t.ref_cells.withColumn("number", F.substring("sample_id", 2, 1)).withColumn("kind",
    F.when(F.col("cell_type") != "t3", F.concat(F.lit("k"), F.col("cell_type"))))
register("a9_profile_metadata", lambda t: pseudobulk.with_constant_columns(pseudobulk.pseudobulk(t.stored("ref_expression"), t.ref_cells,
    groups="cell_type", min_cells=83), _noted(t), ["sample_id", "cell_type"]), "ref_cells ref_expression", f"""{_PB}
    SELECT sample_id, cell_type, gene, sum(count) AS value, round(count(*) / n_cells::DOUBLE, 6) AS prop, n_cells, counts, substr(sample_id, 2,
    1) AS number, CASE WHEN cell_type <> 't3' THEN concat('k', cell_type) END AS kind FROM x JOIN st USING (sample_id, cell_type) GROUP BY sample_id,
    cell_type, gene, n_cells, counts""")
register("a9_distinct_values", lambda t: pseudobulk.distinct_values(t.ref_cells.withColumn("half", F.substring("tissue", 1, 1)), ["sample_id", "cell_type"],
    ["tissue", "half"]), "ref_cells",
    "SELECT max(a) AS tissue, max(b) AS half FROM (SELECT count(DISTINCT tissue) AS a, count(DISTINCT substr(tissue, 1, 1)) AS b FROM ref_cells "
    "GROUP BY sample_id, cell_type)")
register("a10_expressed_genes", lambda t: pseudobulk.expressed_genes(_pb(t, "sum"), 0.1, 2), "ref_cells ref_expression",
    f"""{_PB}, p AS (SELECT sample_id, cell_type, gene, count(*) / n_cells::DOUBLE AS prop FROM x JOIN st USING (sample_id, cell_type) GROUP BY sample_id,
    cell_type, gene, n_cells)
    SELECT gene FROM p WHERE prop >= 0.1 GROUP BY 1 HAVING count(*) >= 2""")
register("a10_expressed_genes_by_group", lambda t: pseudobulk.expressed_genes(_pb(t, "sum"), 0.12, 2, "cell_type"), "ref_cells ref_expression",
    f"""{_PB}, p AS (SELECT sample_id, cell_type, gene, count(*) / n_cells::DOUBLE AS prop FROM x JOIN st USING (sample_id, cell_type) GROUP BY sample_id,
    cell_type, gene, n_cells)
    SELECT DISTINCT gene FROM (SELECT gene FROM p WHERE prop >= 0.12 GROUP BY gene, cell_type HAVING count(*) >= 2)""")
register("a14_type_means", lambda t: pseudobulk.type_means(t.ref_expression, t.ref_cells), "ref_cells ref_expression",
    """, n AS (SELECT cell_type, count(*) AS n FROM ref_cells GROUP BY 1)
    SELECT cell_type, gene, round(sum(count) / n, 6) AS mean FROM ref_expression JOIN ref_cells USING (cell_id) JOIN n USING (cell_type) GROUP BY cell_type,
    gene, n""")
register("u2_common_genes_of_prepared", lambda t: _prepared(t).groupBy("gene").agg(F.count_distinct("sample_id").alias("n")).filter("n = 3").select("gene"),
    "expression spots", f"{_G} SELECT gene FROM prepared GROUP BY 1 HAVING count(DISTINCT sample_id) = 3")
