"""Queries on samples, files, genes, metrics and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissueflow.functions import scalars
from tissueflow.operators import genes, metrics, pseudobulk, qc, samples
from tissueflow.plans.fixtures import GENES, Tables
from tissueflow.plans.registry import register
from tissueflow.sources import cell_store, tables
from tissueflow.sources.store import new_path
from tissueflow.streaming.cells import append_stream

# files: each query writes what it then reads


def _saved(df: DataFrame, name: str, **csv) -> str:
    path = new_path(df.sparkSession, name)
    df.write.csv(path, **csv) if csv else df.write.parquet(path)
    return path


register("s1_read_samples", lambda t: tables.read_samples(t.spark, _saved(t.samples, "samples", header=True, escape='"')), "samples", "SELECT * FROM samples")
register("s2_read_transcripts", lambda t: tables.read_transcripts(t.spark, _saved(t.transcripts.withColumn("other", F.lit(1)), "transcripts")),
    "transcripts", "SELECT * FROM transcripts")


def _read_expression(t: Tables) -> DataFrame:
    path = new_path(t.spark, "expression")
    t.expression.withColumn("spot_id", F.concat(F.lit("s"), F.col("spot_pos").cast("string"))).write.partitionBy("sample_id").parquet(path)
    return tables.read_expression(t.spark, path, ["SA", "SR"])


register("s3_read_expression", _read_expression, "expression", "SELECT * FROM expression WHERE sample_id IN ('SA', 'SR')")
register("s4_read_cells", lambda t: tables.read_cells(t.spark,
    _saved(t.cells.withColumn("label", F.when(F.col("label") > 2, F.col("label"))).withColumn("spot_id", F.when(F.col("cell_idx") % 2 == 0,
    "None").otherwise("s")), "cells")).withColumn("spot_id", F.coalesce("spot_id", F.lit("-"))), "cells",
         "SELECT * REPLACE (CAST(CASE WHEN label > 2 THEN label ELSE -1 END AS BIGINT) AS label), "
         "CASE WHEN cell_idx % 2 = 0 THEN '-' ELSE 's' END AS spot_id FROM cells")
register("s5_read_genes", lambda t: tables.read_genes(t.spark, _saved(t.gene_list, "genes", header=True)), "gene_list", "SELECT * FROM gene_list")
register("s5_read_markers", lambda t: tables.read_markers(t.spark,
    _saved(t.signature.select(F.lit(1).alias("idx"), F.col("celltype").alias("group"), F.length("gene").cast("double").alias("scores"), "gene"), "markers",
    header=True)), "signature", 'SELECT celltype AS "group", CAST(length(gene) AS DOUBLE) AS scores, gene FROM signature')


def _export(t: Tables, part: str) -> DataFrame:
    path = new_path(t.spark, "spot-files")
    tables.export_spot_files(t.expression, t.spots, GENES, path, 110.0, 1.0)
    return t.spark.read.csv(f"{path}/{part}.tsv", sep="\t", header=True, inferSchema=True)


_WIDE = ", ".join(f"coalesce(max(count) FILTER (gene = '{g}'), 0) AS \"{g}\"" for g in GENES)
register("s6_export_counts", lambda t: _export(t, "cnts"), "expression", f"SELECT spot_id AS spot, {_WIDE} FROM expression GROUP BY 1")
register("s6_export_places", lambda t: _export(t, "locs-raw"), "spots", "SELECT spot_id AS spot, x, y FROM spots")


def _append(t: Tables) -> DataFrame:
    """A draft that is replaced, a load of two batches that is asked for twice, and a third batch added."""
    path = new_path(t.spark, "store")
    part = lambda k: t.cells.filter(F.col("cell_idx") % 3 == k)
    tables.append_cells([t.cells.withColumn("label", F.lit(9))], path, "draft")
    for _ in range(2):
        tables.append_cells([part(0), part(1)], path, "first")
    tables.append_cells([part(2)], path, "second", replace=False)
    return cell_store.read(t.spark, path)


register("s7_append_cells", _append, "cells", "SELECT * REPLACE (CAST(label AS BIGINT) AS label) FROM cells")


def _streamed(t: Tables) -> DataFrame:
    came, path = _saved(t.cells.repartition(4, "cell_idx"), "came"), new_path(t.spark, "store")
    stream = t.spark.readStream.schema(t.cells.schema).option("maxFilesPerTrigger", 2).parquet(came)
    append_stream(stream, path, new_path(t.spark, "stream-checkpoint")).awaitTermination()
    return cell_store.read(t.spark, path)


register("s7_stream_cells", _streamed, "cells", "SELECT * REPLACE (CAST(label AS BIGINT) AS label) FROM cells")


def _saved_results(t: Tables) -> DataFrame:
    path = new_path(t.spark, "results")
    for slide in ("SA", "SN"):
        tables.save_results(_metrics(t), path, "a=1;b=HVG:10", slide, "bag")
    return t.spark.read.parquet(path)


def _results(t: Tables) -> DataFrame:
    return _saved_results(t).groupBy("exp_tag", "test_slide", "infer_mode").agg(F.count("*").alias("n"))


def _runs(t: Tables) -> DataFrame:
    path = new_path(t.spark, "runs")
    for k in range(3):
        t.raw("part").filter(F.col("p_partkey") % 3 == k).select("p_name", F.col("p_retailprice").alias("score")).write.json(f"{path}/run{k}/metrics.json")
        t.spark.createDataFrame([(f"model.lr={k / 4}",), (f"- data.genes=HVG:{k}",), (f"seed={k}",)],
        "value string").write.text(f"{path}/run{k}/{'.hydra/overrides.yaml' if k else 'overrides.txt'}")
    # Spark's writer makes folders; the files in them are what a run leaves
    return tables.load_runs(t.spark, path)


register("s9_load_runs", lambda t: _runs(t).drop("run"), "", "SELECT p_name, round(p_retailprice, 6) AS score, (p_partkey % 3) / 4.0::DOUBLE AS lr, "
    "concat('HVG:', p_partkey % 3) AS genes, CAST(p_partkey % 3 AS DOUBLE) AS seed FROM part")
register("s10_without_organ", lambda t: tables.without_samples(t.samples.withColumnRenamed("id", "sample_id"), t.samples, F.col("organ").isin("o1", "o4")),
    "samples", "SELECT * RENAME (id AS sample_id) FROM samples WHERE organ NOT IN ('o1', 'o4')")
register("s10_without_ids", lambda t: tables.without_samples(t.samples.withColumnRenamed("id", "sample_id"), t.samples, F.col("id") == "1"), "samples",
    "SELECT * RENAME (id AS sample_id) FROM samples WHERE id <> '1'")


def _panel(t: Tables) -> DataFrame:
    path = new_path(t.spark, "panel")
    tables.save_panel(t.gene_list, path)
    return tables.read_genes(t.spark, path)


register("s11_save_panel", _panel, "gene_list", "SELECT DISTINCT gene FROM gene_list")

# samples
register("f1_filter_samples", lambda t: samples.filter_samples(t.samples_of_texts, "o3"), "samples_of_texts",
    "SELECT * FROM samples_of_texts WHERE species = 'Homo sapiens' AND st_technology IN ('Visium', "
    "'Xenium') AND (preservation_method = 'FFPE' OR coalesce(subseries ILIKE '%ffpe%', false)) AND organ = 'o3'")
register("f2_pick_samples", lambda t: samples.pick_samples(t.samples, ["42", "7", "100"]), "samples",
    "SELECT CASE id WHEN '42' THEN 0 WHEN '7' THEN 1 ELSE 2 END::BIGINT AS pos, * FROM samples WHERE id IN ('42', '7', '100')")
register("p2_leave_one_out", lambda t: samples.leave_one_out(t.expression, ["SA", "SN", "SR"], 1), "expression",
    "SELECT * FROM expression WHERE sample_id <> 'SN'")
register("u5_common_radius", lambda t: t.slide_meta.withColumn("radius", F.lit(samples.common_radius(t.slide_meta))).select("sample_id", "radius"),
    "slide_meta", "SELECT sample_id, CAST(floor(spot_diameter) AS BIGINT) // 2 AS radius FROM slide_meta")

# genes
register("f12_panel_report", lambda t: genes.panel_report(t.expression, t.gene_list), "expression gene_list",
    "SELECT DISTINCT gene FROM gene_list SEMI JOIN expression USING (gene)")
register("f12_restrict_panel", lambda t: genes.restrict_panel(t.expression, t.gene_list), "expression gene_list",
    "SELECT * FROM expression WHERE gene IN (SELECT gene FROM gene_list)")
register("u1_panel_union", lambda t: genes.panel_union(t.transcripts.withColumnRenamed("feature_name", "gene")), "transcripts",
    "SELECT DISTINCT feature_name AS gene FROM transcripts WHERE NOT regexp_matches(feature_name, '^(BLANK_|NegControlCodeword_|NegControlProbe_|antisense_)')")
register("u2_common_genes", lambda t: genes.common_genes(t.expression), "expression",
    "SELECT gene FROM expression GROUP BY 1 HAVING count(DISTINCT sample_id) = 3")
register("u3_stack", lambda t: genes.stack({s: t.stored("expression").filter(F.col("sample_id") == s) for s in ("SA", "SN", "SR")}), "expression", """
    SELECT *, sample_id AS batch, concat(spot_id, '_', sample_id) AS row_id FROM expression WHERE gene IN (SELECT gene FROM expression GROUP BY 1
    HAVING count(DISTINCT sample_id) = 3)""")
register("t3_gene_order", lambda t: t.signature.select("gene").distinct().orderBy("gene"), "signature", "SELECT DISTINCT gene FROM signature")
register("w9_unique_names", lambda t: genes.unique_names(t.raw("part").select(F.concat_ws("-", "p_brand", F.when(F.col("p_size") % 9 == 0,
    F.lit("2"))).alias("gene"), F.col("p_partkey").alias("pos"))), "",
    """WITH d AS (SELECT CASE WHEN p_size % 9 = 0 THEN concat(p_brand, '-2') ELSE p_brand END AS gene, p_partkey AS pos FROM part), k AS (SELECT *,
    row_number() OVER (PARTITION BY gene ORDER BY pos) - 1 AS k FROM d)
    SELECT gene, pos, CASE WHEN k = 0 THEN gene WHEN k >= 2 AND concat(gene, '-2') IN (SELECT gene FROM d) THEN concat(gene, '-', k + 1) ELSE concat(gene,
    '-', k) END AS "unique" FROM k""")
register("a17_highly_variable", lambda t: genes.highly_variable(t.stored("expression"), t.spots, 50, ["sample_id"]))
register("a18_common_highly_variable", lambda t: genes.common_highly_variable(t.stored("expression"), t.spots, 50))
register("a21_common_highly_expressed", lambda t: genes.common_highly_expressed(t.expression, t.spots, 25), "expression spots",
    "SELECT gene, round(sum(count / 500.0::DOUBLE) / 3, 6) AS score FROM expression GROUP BY 1 ORDER BY sum(count) DESC, gene LIMIT 25")
_value = lambda t: qc.log1p(qc.normalise_median(t.stored("ref_expression")))
_TYPES = """, s AS (SELECT cell_id, sum(count) AS total FROM ref_expression GROUP BY 1), v AS (SELECT cell_id, gene, ln(1 + count * (SELECT median(total) FROM s) / total) AS value FROM ref_expression JOIN s USING (cell_id)),
    dense AS (SELECT c.cell_id, c.cell_type, g.gene, coalesce(value, 0) AS value FROM ref_cells c CROSS JOIN (SELECT DISTINCT gene FROM ref_expression) g LEFT JOIN v ON v.cell_id = c.cell_id AND v.gene = g.gene),
    every AS (SELECT t.cell_type AS own, d.* FROM dense d CROSS JOIN (SELECT DISTINCT cell_type FROM ref_cells) t),
    scores AS (SELECT own AS cell_type, gene, coalesce((avg(value) FILTER (own = cell_type) - avg(value) FILTER (own <> cell_type)) / nullif(sqrt((var_samp(value) FILTER (own = cell_type) + var_samp(value) FILTER (own <> cell_type)) / count(*) FILTER (own = cell_type)), 0), 0) AS score FROM every GROUP BY 1, 2)"""
_scores = lambda t: genes.rank_markers(_value(t), t.ref_cells)
register("a22_rank_markers", _scores, "ref_cells ref_expression", f"{_TYPES} SELECT cell_type, gene, round(score, 6) AS score FROM scores")
_TOP = f"{_TYPES}, top AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY round(score, 9) DESC, gene) AS rank FROM scores QUALIFY rank <= 20)"
register("w4_top_markers", lambda t: genes.top_markers(_scores(t)), "ref_cells ref_expression",
    f"{_TOP} SELECT cell_type, gene, round(score, 6) AS score, rank FROM top")
register("w5_marker_union", lambda t: genes.marker_union(genes.top_markers(_scores(t), 5)), "ref_cells ref_expression",
    f"{_TOP} SELECT DISTINCT gene FROM top WHERE rank <= 5")
register("w4_merge_groups", lambda t: genes.merge_groups(t.ref_cells, "cell_type",
    {"t1": "t12", "t2": "t12"}).groupBy("cell_type").agg(F.count("*").alias("n")), "ref_cells",
    "SELECT CASE WHEN cell_type IN ('t1', 't2') THEN 't12' ELSE cell_type END AS cell_type, count(*) AS n FROM ref_cells GROUP BY 1")
register("j9_scores_keep_genes", lambda t: genes.top_markers(_scores(t), 3).select("cell_type", "gene", "rank"), "ref_cells ref_expression",
    f"{_TOP} SELECT cell_type, gene, rank FROM top WHERE rank <= 3")
register("j15_marker_mask", lambda t: genes.marker_mask(t.expression.select("gene"), t.signature), "expression signature",
    """, c AS (SELECT unnest(['Connective', 'Dead', 'Epithelial', 'Inflammatory', 'Neoplastic', 'Nolabel']) AS celltype), g AS (SELECT DISTINCT gene
    FROM expression)
    SELECT celltype, gene, CASE WHEN gene NOT IN (SELECT gene FROM signature) THEN 1 ELSE CAST(EXISTS (SELECT 1 FROM signature s
    WHERE s.gene = g.gene AND s.celltype = c.celltype) AS BIGINT) END AS mask FROM c CROSS JOIN g""")
register("a23_marker_set_score", lambda t: genes.marker_set_score(t.stored("expression"), t.spots, t.signature.withColumnRenamed("celltype", "set"),
    "count"), "expression spots signature", """, m AS (SELECT DISTINCT celltype AS "set", gene FROM signature WHERE gene IN (SELECT gene FROM expression))
    SELECT s.sample_id, s.spot_id, m."set", round(sum(coalesce(count, 0)) / count(*), 6) AS score FROM spots s CROSS JOIN m LEFT
    JOIN expression e ON e.spot_id = s.spot_id AND e.gene = m.gene GROUP BY ALL""")

# metrics
_ALIGN = """, shared AS (SELECT DISTINCT gene FROM truth INTERSECT SELECT DISTINCT gene FROM pred),
    aligned AS (SELECT s.spot_id, g.gene, coalesce(t.value, 0) AS y, coalesce(p.value, 0) AS p FROM spots s CROSS JOIN shared g LEFT JOIN truth t ON t.spot_id = s.spot_id AND t.gene = g.gene LEFT JOIN pred p ON p.spot_id = s.spot_id AND p.gene = g.gene)"""


def _scored(by: str) -> str:
    return f"""{_ALIGN}, r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0::DOUBLE AS ry,
    rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0::DOUBLE AS rp FROM aligned),
    metrics AS (SELECT {by}, CASE WHEN min(y) < max(y) AND min(p) < max(p) THEN corr(y, p) END AS pcc,
    CASE WHEN min(y) < max(y) AND min(p) < max(p) THEN corr(ry, rp) END AS scc, avg((y - p) * (y - p)) AS mse FROM r GROUP BY 1)"""


_aligned = lambda t: metrics.align(t.stored("truth"), t.stored("pred"), t.spots)
_metrics = lambda t: metrics.sparse_metrics(t.stored("truth"), t.stored("pred"), t.spots)
_M = "truth pred spots"
_R = "round(pcc, 6) AS pcc, round(scc, 6) AS scc, round(mse, 6) AS mse"
register("s8_save_results", _results, _M, f"{_scored('gene')} SELECT 'a=1;b=HVG:10' AS exp_tag, test_slide, 'bag' AS infer_mode, count(*) AS n FROM metrics "
    f"CROSS JOIN (SELECT unnest(['SA', 'SN']) AS test_slide) GROUP BY 1, 2, 3")
register("s8_saved_metrics", _saved_results, _M, f"{_scored('gene')} SELECT gene, {_R}, 'a=1;b=HVG:10' AS exp_tag, test_slide, 'bag' AS infer_mode "
    f"FROM metrics CROSS JOIN (SELECT unnest(['SA', 'SN']) AS test_slide)")
register("j6_align", lambda t: _aligned(t).drop("sample_id"), _M, f"{_ALIGN} SELECT spot_id, gene, round(y, 6) AS y, round(p, 6) AS p FROM aligned")
register("j6_gene_overlap", lambda t: metrics.gene_overlap(t.stored("truth"), t.stored("pred")), "truth pred",
    "SELECT count(DISTINCT gene) AS n_measured, (SELECT count(DISTINCT gene) FROM pred) AS n_predicted, (SELECT count(*) FROM (SELECT gene "
    "FROM truth INTERSECT SELECT gene FROM pred)) AS n_both FROM truth")
register("w1_average_ranks", lambda t: metrics.average_ranks(t.expression.select("spot_id", "gene", "count"), "count", "rank"), "expression",
    "SELECT spot_id, gene, count, rank() OVER (PARTITION BY gene ORDER BY count) + (count(*) OVER (PARTITION BY gene, count) - 1) / 2.0::DOUBLE AS rank "
    "FROM expression")
register("a6_gene_metrics", _metrics, _M, f"{_scored('gene')} SELECT gene, {_R} FROM metrics")
register("a6_mean_metrics", lambda t: metrics.mean_metrics(_metrics(t)), _M,
    f"{_scored('gene')} SELECT round(avg(pcc), 6) AS pcc, round(avg(scc), 6) AS scc, round(avg(mse), 6) AS mse FROM metrics")
# the p-value by the finite series of Student's t for whole degrees of freedom (v = n - 2): A = P(|T| <= t) with tan(theta) = t / sqrt(v)
_STUDENT = """CASE WHEN v % 2 = 0 THEN r * list_sum([exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2)) * power(1 - r * r, k) FOR k IN range(0, v // 2)])
    ELSE 2 / pi() * (asin(r) + r * coalesce(list_sum([exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * power(1 - r * r, k + 0.5) FOR k IN range(0, (v - 1) // 2)]), 0)) END"""
register("a7_spot_correlation", lambda t: metrics.sparse_spot_correlation(t.stored("truth"), t.stored("pred"), t.spots).drop("sample_id"), _M,
    f"""{_scored('spot_id')},
    tail AS (SELECT spot_id, pcc, least(abs(pcc), 1) AS r, (SELECT count(*) FROM shared) - 2 AS v FROM metrics)
    SELECT spot_id, round(pcc, 6) AS pcc, CASE WHEN v > 0 AND pcc IS NOT NULL THEN round(greatest(0, 1 - ({_STUDENT})), 6) END AS p_value FROM tail""")


def _in_batches(t: Tables) -> DataFrame:
    d = _aligned(t).withColumn("b", F.pmod(F.xxhash64("spot_id"), F.lit(4)))
    parts = [metrics.moments(d.filter(F.col("b") == k)) for k in range(4)]
    return metrics.merged_metrics(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))


register("a25_merged_metrics", _in_batches, _M, f"{_scored('gene')} SELECT gene, round(pcc, 6) AS pcc, round(mse, 6) AS mse FROM metrics")
register("a13_nb_loss", lambda t: metrics.nb_loss(t.expression.withColumn("mu", F.col("count") * 0.5 + 3).withColumn("theta", F.lit(2.5))), "expression",
    """, l AS (SELECT spot_id, count AS x, count * 0.5::DOUBLE + 3 AS mu, 2.5::DOUBLE AS th FROM expression)
    SELECT round(-avg(s), 6) AS loss FROM (SELECT spot_id, sum(th * (ln(th + 1e-8) - ln(th + mu + 1e-8)) + x * (ln(mu + 1e-8) - ln(th + mu + 1e-8)) +
    lgamma(x + th) - lgamma(th) - lgamma(x + 1)) AS s FROM l GROUP BY 1)""")
register("fn12_nb_log_prob", lambda t: t.raw("part").select("p_partkey",
    scalars.nb_log_prob(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.lit(1.5)).alias("ll")), "",
    """SELECT p_partkey, round(1.5 * (ln(1.5 + 1e-8) - ln(1.5 + mu + 1e-8)) + p_size * (ln(mu + 1e-8) - ln(1.5 + mu + 1e-8)) + lgamma(p_size + 1.5) -
    lgamma(1.5::DOUBLE) - lgamma(p_size + 1.0), 6) AS ll FROM (SELECT *, p_retailprice / 100 AS mu FROM part)""")
register("fn12_zinb_log_prob", lambda t: t.raw("part").select("p_partkey",
    scalars.zinb_log_prob((F.col("p_size") % 5).cast("double"), F.col("p_retailprice") / 100, F.lit(1.5), F.lit(-0.7)).alias("ll")), "",
    """SELECT p_partkey, round(CASE WHEN x < 1e-8 THEN ln(1 + exp(1.5 * d + 0.7)) - ln(1 + exp(0.7)) ELSE 1.5 * d + x * (ln(mu + 1e-8) - ln(1.5 + mu +
    1e-8)) + lgamma(x + 1.5) - lgamma(1.5::DOUBLE) - lgamma(x + 1.0) + 0.7 - ln(1 + exp(0.7)) END, 6) AS ll
    FROM (SELECT p_partkey, p_size % 5 AS x, p_retailprice / 100 AS mu, ln(1.5 + 1e-8) - ln(1.5 + p_retailprice / 100 + 1e-8) AS d FROM part)""")
register("a24_adjusted_rand_index", lambda t: metrics.adjusted_rand_index(t.cells.select(F.when(F.col("label") == -1,
    "undetermined").otherwise(F.col("label").cast("string")).alias("a"),
    ((F.col("label") + (F.col("cell_idx") % 5 == 0).cast("int")) % 4).cast("string").alias("b"))), "cells",
    """, l AS (SELECT label AS a, (label + CAST(cell_idx % 5 = 0 AS INT)) % 4 AS b FROM cells WHERE label <> -1), c AS (SELECT a, b, count(*)::DOUBLE AS n
    FROM l GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) AS s FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c
    GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b)), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS s FROM c)
    SELECT round((x.s - a.s * b.s / t.s) / ((a.s + b.s) / 2 - a.s * b.s / t.s), 6) AS ari FROM x, a, b, t""")
_tagged = lambda t: metrics.wide_metrics(_metrics(t).withColumn("tag", F.lit("run")), t.genes20)
register("j10_long_metrics", lambda t: metrics.long_metrics(_tagged(t)), _M,
    f"{_scored('gene')} SELECT 'run' AS tag, g.gene, {_R} FROM (SELECT concat('G', unnest(range(13, 33))) AS gene) g LEFT JOIN metrics m ON m.gene = g.gene")
register("a27_metric_quartiles", lambda t: metrics.metric_quartiles(t.raw("part").select("p_retailprice", "p_brand", "p_size"), ["p_brand", "p_size"],
    "p_retailprice"), "", """SELECT param, setting, count(*) AS n, round(min(m), 6) AS least, round(quantile_cont(m, 0.25), 6) AS q1, round(quantile_cont(m,
    0.5), 6) AS median, round(quantile_cont(m, 0.75), 6) AS q3, round(max(m), 6) AS most
    FROM (SELECT 'p_brand' AS param, p_brand AS setting, p_retailprice AS m FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), p_retailprice
    FROM part) GROUP BY 1, 2""")
register("t1_top_cells", lambda t: metrics.top_cells(t.ref_expression, "G20", 15), "ref_expression",
    "SELECT * FROM ref_expression WHERE gene = 'G20' ORDER BY count DESC, cell_id LIMIT 15")
register("t2_top_genes", lambda t: metrics.top_genes(_metrics(t), t.stored("truth"), t.stored("pred")), _M,
    f"{_scored('gene')} SELECT gene, {_R} FROM metrics ORDER BY round(scc, 9) DESC NULLS LAST, gene LIMIT 10")

# scalar functions
_tag = lambda: F.concat(F.lit("model=mil;lr="), F.col("p_size").cast("string"), F.lit(";genes=HVG:"), F.col("p_partkey").cast("string"))
register("fn1_parse_tag", lambda t: t.raw("part").select("p_partkey", scalars.parse_tag(_tag()).alias("m")).select("p_partkey",
    F.col("m")["lr"].alias("lr"), F.col("m")["genes"].alias("genes")), "",
    "SELECT p_partkey, CAST(p_size AS VARCHAR) AS lr, concat('HVG:', p_partkey) AS genes FROM part")
register("fn1_build_tag", lambda t: t.raw("part").select("p_partkey",
    scalars.build_tag(F.create_map(F.lit("lr"), F.col("p_size").cast("string"), F.lit("data_dir"), F.lit("x"), F.lit("brand"),
    F.col("p_brand"))).alias("tag"), scalars.train_slide(F.array("p_name"), F.when(F.col("p_size") > 25, F.col("p_size"))).isNull().alias("by_fold")), "",
    "SELECT p_partkey, concat('lr=', p_size, ';brand=', p_brand) AS tag, p_size > 25 AS by_fold FROM part")
register("fn2_gene_spec", lambda t: t.raw("part").select("p_partkey",
    scalars.gene_spec(F.concat(F.lit("HVG:"), F.col("p_size").cast("string"))).alias("s")).select("p_partkey", "s.method", "s.n"), "",
    "SELECT p_partkey, 'HVG' AS method, CAST(p_size AS BIGINT) AS n FROM part")
register("fn3_stable_int", lambda t: t.spots.select("spot_id", scalars.stable_int(F.col("spot_id")).alias("k")), "spots",
    "SELECT spot_id, CAST(('0x' || md5(spot_id))::UHUGEINT % 100000000 AS BIGINT) AS k FROM spots")
register("fn4_embedding_stem", lambda t: t.cells.select("cell_idx",
    scalars.embedding_stem(F.concat(F.lit("/a_b/resnet50_"), "sample_id", F.lit(".h5"))).alias("s")).select("cell_idx", "s.key", "s.sample_id"), "cells",
    "SELECT cell_idx, 'resnet50' AS key, sample_id FROM cells")
register("fn14_category_codes", lambda t: scalars.category_codes(t.ref_cells.select("cell_id", "tissue"), "tissue", "code"), "ref_cells",
    "SELECT cell_id, tissue, dense_rank() OVER (ORDER BY tissue) - 1 AS code FROM ref_cells")
register("fn15_nb_moments", lambda t: t.raw("part").select("p_partkey", scalars.nb_variance(F.col("p_retailprice"), F.lit(2.0)).alias("variance"),
    scalars.nb_to_logits(F.col("p_retailprice"), F.lit(2.0))["logits"].alias("logits"), scalars.nb_from_logits(F.lit(2.0), F.lit(0.5))["mu"].alias("mu")),
    "", "SELECT p_partkey, round(p_retailprice + p_retailprice * p_retailprice / 2, 6) AS variance, round(ln(p_retailprice + 1e-8) - ln(2 + 1e-8), "
    "6) AS logits, round(2 * exp(0.5), 6) AS mu FROM part")
register("j8_class_names", lambda t: t.cells.select("cell_idx", F.coalesce(scalars.class_name(F.col("label") * 2 - 1), F.lit("-")).alias("class")), "cells",
    "SELECT cell_idx, CASE label * 2 - 1 WHEN 0 THEN 'Connective' WHEN 1 THEN 'Dead' WHEN 2 THEN 'Epithelial' WHEN 3 THEN 'Inflammatory' WHEN 4 THEN "
    "'Neoplastic' WHEN -1 THEN 'Nolabel' ELSE '-' END AS class FROM cells")
