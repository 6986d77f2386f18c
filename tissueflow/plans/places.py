"""Queries on spots, cells and their neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tissueflow.operators import genes, sampling, spatial
from tissueflow.operators.pseudobulk import type_means
from tissueflow.plans.registry import register


def _hit(r: int) -> str:
    return f"hit AS (SELECT c.sample_id, c.cell_idx, max(s.spot_pos) AS p FROM cells c JOIN spots s ON c.sample_id = s.sample_id AND (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= {r * r} GROUP BY ALL), assigned AS (SELECT c.*, CASE WHEN p IS NOT NULL THEN concat('s', CAST(p AS STRING), '_', c.sample_id) END AS spot_id FROM cells c LEFT JOIN hit h ON c.cell_idx = h.cell_idx)"


_assigned = lambda t, r=60: spatial.radius_join(t.cells, t.spots, r)
for _r in (40, 60):
    register(f"j1_radius_join_{_r}", lambda t, r=_r: _assigned(t, r), "cells spots", f", {_hit(_r)} SELECT * FROM assigned")
register("j2_cells_of_spot", lambda t: _assigned(t, 40).filter("spot_id = 's77_SA'").select("cell_idx"), "cells spots",
    "SELECT c.cell_idx FROM cells c JOIN spots s ON s.spot_id = 's77_SA' AND c.sample_id = 'SA' WHERE sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2) <= 40")
register("a26_coverage", lambda t: spatial.coverage(_assigned(t), t.spots), "cells spots",
    f""", {_hit(60)} SELECT a.sample_id, count(*) AS n_cells, count(spot_id) AS n_matched, count(DISTINCT spot_id) AS n_spots_with_cells, 500 AS n_spots,
    round(100.0::DOUBLE * count(spot_id) / count(*), 6) AS percent FROM assigned a GROUP BY 1""")
register("a2_spot_cell_lists", lambda t: spatial.spot_cell_lists(_assigned(t)).withColumn("cells", F.array_join(F.col("cells").cast("array<string>"), ",")),
    "cells spots", f", {_hit(60)} SELECT sample_id, spot_id, string_agg(CAST(cell_idx AS VARCHAR), ',' ORDER BY cell_idx) AS cells FROM assigned "
    f"WHERE spot_id IS NOT NULL GROUP BY 1, 2")
register("a3_cells_per_spot", lambda t: spatial.cells_per_spot(t.spots, _assigned(t, 40)).select("sample_id", "spot_id",
    F.col("n_cells").cast("double").alias("n_cells")), "cells spots",
    f", {_hit(40)} SELECT s.sample_id, s.spot_id, CAST(nullif(count(a.cell_idx), 0) AS DOUBLE) AS n_cells FROM spots s LEFT "
    f"JOIN assigned a ON a.spot_id = s.spot_id GROUP BY ALL")
register("j3_bags", lambda t: spatial.bags(t.expression, _assigned(t, 40)).withColumn("cells", F.array_join(F.col("cells").cast("array<string>"), ",")),
    "cells spots expression", f", {_hit(40)} SELECT sample_id, spot_id, string_agg(CAST(cell_idx AS VARCHAR), ',' ORDER BY cell_idx) AS cells "
    f"FROM assigned a WHERE EXISTS (SELECT 1 FROM expression e WHERE e.spot_id = a.spot_id) GROUP BY 1, 2")
register("j3_bag_coverage", lambda t: spatial.bag_coverage(t.expression, _assigned(t, 40)), "cells spots expression",
    f""", {_hit(40)}, e AS (SELECT DISTINCT sample_id, spot_id FROM expression), c AS (SELECT DISTINCT sample_id, spot_id FROM assigned
    WHERE spot_id IS NOT NULL)
    SELECT coalesce(e.sample_id, c.sample_id) AS sample_id, count(e.spot_id) AS n_expression, count(c.spot_id) AS n_cells,
    count(*) FILTER (e.spot_id IS NOT NULL AND c.spot_id IS NOT NULL) AS n_both,
    round(count(*) FILTER (e.spot_id IS NOT NULL AND c.spot_id IS NOT NULL) / count(e.spot_id)::DOUBLE, 6) AS of_expression,
    round(count(*) FILTER (e.spot_id IS NOT NULL AND c.spot_id IS NOT NULL) / count(c.spot_id)::DOUBLE, 6) AS of_cells FROM e FULL
    JOIN c ON e.spot_id = c.spot_id GROUP BY 1""")
register("f4_patch_boxes", lambda t: spatial.patch_boxes(t.cells, t.slide_meta).select("cell_idx", "left", "top", "size"), "cells slide_meta",
    """SELECT cell_idx, CAST(trunc(l) AS BIGINT) AS "left", CAST(trunc(u) AS BIGINT) AS top, CAST(trunc(size) AS BIGINT) AS size
    FROM (SELECT *, x - floor(size / 2) AS l, y - floor(size / 2) AS u FROM (SELECT *, 72 * (0.25 / pixel_size) AS size FROM cells
    JOIN slide_meta USING (sample_id))) WHERE l + size >= 0 AND l < width AND u + size >= 0 AND u < height""")
_EDGES = "edges AS (SELECT a.sample_id, a.spot_id AS src, b.spot_id AS dst FROM spots a JOIN spots b ON a.sample_id = b.sample_id AND ((a.array_row = b.array_row AND abs(a.array_col - b.array_col) = 2) OR (abs(a.array_row - b.array_row) = 1 AND abs(a.array_col - b.array_col) = 1)))"
register("j13_hex_neighbours", lambda t: spatial.hex_neighbours(t.spots), "spots", f", {_EDGES} SELECT * FROM edges")
register("j13_nearest_neighbours", lambda t: spatial.nearest_neighbours(t.spots), "spots",
    """, d AS (SELECT a.sample_id, a.spot_id AS src, b.spot_id AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM spots a
    JOIN spots b ON a.sample_id = b.sample_id AND a.spot_id <> b.spot_id AND abs(a.x - b.x) <= 250 AND abs(a.y - b.y) <= 250),
    k AS (SELECT * FROM d WHERE d <= 250 QUALIFY row_number() OVER (PARTITION BY sample_id, src ORDER BY d, dst) <= 6) SELECT sample_id, src, dst FROM k
    QUALIFY d < 1.3 * median(d) OVER (PARTITION BY sample_id)""")
register("j14_position_join", lambda t: spatial.position_join(t.expression.withColumn("id", F.concat(((F.col("spot_pos") % 25) * 100).cast("int"),
    F.lit("x"), (F.floor(F.col("spot_pos") / 50) * 174).cast("int"))).select("id", "gene", "count"), t.spots.filter("sample_id = 'SA'").select("x", "y")),
    "expression spots",
    "SELECT concat(CAST(x AS BIGINT), 'x', CAST(y AS BIGINT)) AS id, gene, count, x, y FROM expression "
    "JOIN spots s ON s.sample_id = 'SA' AND x = (expression.spot_pos % 25) * 100 AND y = floor(expression.spot_pos / 50) * 174")
register("fn9_standardised_coordinates", lambda t: spatial.standardise_coordinates(t.spots), "spots",
    "SELECT * REPLACE (round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS x, round((y - avg(y) OVER w) / stddev_pop(y) OVER w, 6) AS y) "
    "FROM spots WINDOW w AS (PARTITION BY sample_id)")
# Moran's I against its dense definition
_MORAN = f"""expr AS (SELECT * FROM expression), {_EDGES}, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM edges),
    dense AS (SELECT s.sample_id, s.spot_id, g.gene, coalesce(count, 0) AS v FROM spots s JOIN (SELECT DISTINCT sample_id, gene
    FROM expr) g ON g.sample_id = s.sample_id LEFT JOIN expr e ON e.spot_id = s.spot_id AND e.gene = g.gene),
    z AS (SELECT *, v - avg(v) OVER (PARTITION BY sample_id, gene) AS z FROM dense), moran AS (SELECT n.sample_id, n.gene, n.n / n.sw * x.s / n.zz AS i FROM
    (SELECT z.sample_id, gene, count(*) AS n, sum(z * z) AS zz, any_value(sw) AS sw FROM z JOIN (SELECT sample_id, sum(w) AS sw FROM w
    GROUP BY 1) t ON t.sample_id = z.sample_id GROUP BY ALL) n JOIN
    (SELECT a.sample_id, a.gene, sum(a.z * b.around) AS s FROM z a JOIN (SELECT src, gene, sum(w * z) AS around FROM w JOIN z ON z.spot_id = w.dst
    GROUP BY ALL) b ON a.spot_id = b.src AND a.gene = b.gene GROUP BY ALL) x ON x.sample_id = n.sample_id AND x.gene = n.gene)"""
_expr = lambda t: t.stored("expression")
_moran = lambda t: spatial.morans_i(_expr(t), t.spots, spatial.hex_neighbours(t.spots))
register("a19_morans_i", _moran, "expression spots", f", {_MORAN} SELECT sample_id, gene, round(i, 6) AS i FROM moran")
register("a19_spatially_variable", lambda t: genes.spatially_variable(_expr(t), t.spots, spatial.hex_neighbours(t.spots), 10).select("sample_id", "gene",
    "rank"), "expression spots", f", {_MORAN} SELECT sample_id, gene, row_number() OVER (PARTITION BY sample_id ORDER BY i DESC, gene) AS rank FROM moran "
    f"QUALIFY rank <= 10")
register("a20_common_spatially_variable", lambda t: genes.common_spatially_variable(_moran(t), 10), "expression spots",
    f", {_MORAN} SELECT gene, round(exp(avg(ln(CASE WHEN i > 0 THEN i END))), 6) AS score FROM moran GROUP BY 1 HAVING count(CASE WHEN i > 0 THEN 1 END) > 0 "
    f"ORDER BY exp(avg(ln(CASE WHEN i > 0 THEN i END))) DESC, gene LIMIT 10")

# samples of cells, batches and bags
register("w6_batches", lambda t: sampling.batches(t.cells, "cell_idx", 128).select("sample_id", "cell_idx", "batch"), "cells",
    "SELECT sample_id, cell_idx, CAST(floor((row_number() OVER (PARTITION BY sample_id ORDER BY cell_idx) - 1) / 128) AS BIGINT) AS batch FROM cells")
register("w7_bag_pointers", lambda t: sampling.bag_pointers(sampling.batches(t.cells, "cell_idx", 128), "cell_idx", "label").select("cell_idx", "pointer"),
    "cells", """, b AS (SELECT *, floor((row_number() OVER (PARTITION BY sample_id ORDER BY cell_idx) - 1) / 128) AS batch FROM cells),
    c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY sample_id, batch ORDER BY cell_idx) <> label THEN 1 ELSE 0 END AS c FROM b) SELECT cell_idx,
    CAST(sum(c) OVER (PARTITION BY sample_id, batch ORDER BY cell_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pointer FROM c""")
register("w8_bag_offsets", lambda t: sampling.bag_offsets(_assigned(t).filter("spot_id is not null"), "spot_id"), "cells spots",
    f", {_hit(60)}, n AS (SELECT sample_id, spot_id, count(*) AS n FROM assigned WHERE spot_id IS NOT NULL GROUP BY ALL) SELECT *, "
    f"CAST(sum(n) OVER (PARTITION BY sample_id ORDER BY spot_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS \"offset\" FROM n")
register("p1_split_sizes", lambda t: sampling.split(t.cells, "cell_idx").groupBy("train").agg(F.count("*").alias("n")), "cells",
    "SELECT train, CASE WHEN train THEN n - CAST(floor(0.2 * n + 1e-9) AS BIGINT) ELSE CAST(floor(0.2 * n + 1e-9) AS BIGINT) END AS n "
    "FROM (SELECT count(*) AS n FROM cells) CROSS JOIN (SELECT unnest([true, false]) AS train)")
register("p3_subsample_sizes", lambda t: sampling.subsample(t.cells, "cell_idx", 777).groupBy("sample_id").agg(F.count("*").alias("n"),
    F.count_distinct("cell_idx").alias("d")), "cells", "SELECT sample_id, least(777, count(*)) AS n, least(777, count(*)) AS d FROM cells GROUP BY 1")
register("p4_per_class_sizes", lambda t: sampling.per_class(t.cells, "cell_idx", 300, "label").groupBy("label").agg(F.count("*").alias("n")), "cells",
    "SELECT CAST(label AS BIGINT) AS label, least(300, count(*)) AS n FROM cells GROUP BY label")
register("p5_halves", lambda t: sampling.halves(t.cells, "cell_idx").groupBy("train").agg(F.count("*").alias("n")), "cells",
    "SELECT train, CASE WHEN train THEN n // 2 ELSE n - n // 2 END AS n FROM (SELECT count(*) AS n FROM cells) CROSS JOIN (SELECT unnest([true, "
    "false]) AS train)")
_typed = lambda t: t.cells.select("cell_idx", F.concat(F.lit("t"), (F.col("label") + 1).cast("string")).alias("cell_type"))
register("p6_pairs_by_type", lambda t: sampling.pair_expression(_typed(t), t.ref_cells,
    "type").join(t.ref_cells.select(F.col("cell_id").alias("ref_cell"), F.col("cell_type").alias("ref_type")), "ref_cell").groupBy("cell_type",
    "ref_type").agg(F.count("*").alias("n")), "cells ref_cells",
    "SELECT concat('t', CAST(label + 1 AS STRING)) AS cell_type, concat('t', CAST(label + 1 AS STRING)) AS ref_type, count(*) AS n FROM cells GROUP BY ALL")
register("p6_pairs_at_random", lambda t: sampling.pair_expression(_typed(t), t.ref_cells, "random").agg(F.count("*").alias("n"),
    F.count_distinct("cell_idx").alias("d")), "cells", "SELECT count(*) AS n, count(*) AS d FROM cells")
register("p6_pairs_by_mean", lambda t: sampling.pair_mean_expression(_typed(t),
    type_means(t.ref_expression, t.ref_cells)).groupBy("cell_idx").agg(F.sum("count").alias("total")), "cells ref_cells ref_expression",
    """, n AS (SELECT cell_type, count(*) AS n FROM ref_cells GROUP BY 1), m AS (SELECT cell_type, sum(count) / any_value(n) AS m FROM ref_expression
    JOIN ref_cells USING (cell_id) JOIN n USING (cell_type) GROUP BY 1)
    SELECT cell_idx, round(m, 6) AS total FROM cells JOIN m ON m.cell_type = concat('t', CAST(label + 1 AS STRING))""")
register("p7_pseudo_spots", lambda t: sampling.draw_pseudo_spots(t.cells, 500, 20).groupBy("spot").agg(F.count("*").alias("n"),
    F.count_distinct("slot").alias("slots")), "", "SELECT spot, 20 AS n, 20 AS slots FROM (SELECT unnest(range(500)) AS spot)")
# the draws themselves, by the same rule in SQL
_H = lambda key, seed: f"CAST('0x' || substr(md5(concat('{seed}:', CAST({key} AS VARCHAR))), 1, 15) AS BIGINT)"
_SEEDED = f", o AS (SELECT *, row_number() OVER (ORDER BY {_H('cell_idx', 0)}, cell_idx) AS place, count(*) OVER () AS n FROM cells)"
register("p1_split_rows", lambda t: sampling.split(t.cells, "cell_idx").select("cell_idx", "train"), "cells",
    f"{_SEEDED} SELECT cell_idx, place <= n - CAST(floor(0.2 * n + 1e-9) AS BIGINT) AS train FROM o")
register("p5_halves_rows", lambda t: sampling.halves(t.cells, "cell_idx").select("cell_idx", "train"), "cells",
    f"{_SEEDED} SELECT cell_idx, place <= n // 2 AS train FROM o")
register("p3_subsample_rows", lambda t: sampling.subsample(t.cells, "cell_idx", 777).select("sample_id", "cell_idx"), "cells",
    f"SELECT sample_id, cell_idx FROM cells QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY {_H('cell_idx', 0)}, cell_idx) <= 777")
register("p4_per_class_rows", lambda t: sampling.per_class(t.cells, "cell_idx", 300, "label").select("label", "cell_idx"), "cells",
    f"SELECT CAST(label AS BIGINT) AS label, cell_idx FROM cells QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_H('cell_idx', 0)}, cell_idx) <= 300")
for _mode, _type in (("type", "cell_type"), ("random", "'any'")):
    register(f"p6_pairs_{_mode}_rows", lambda t, m=_mode: sampling.pair_expression(_typed(t), t.ref_cells, m).select("cell_idx", "ref_cell"),
    "cells ref_cells", f""", r AS (SELECT cell_id, {_type} AS k, row_number() OVER (PARTITION BY {_type} ORDER BY {_H('cell_id', 0)}, cell_id) - 1 AS draw
    FROM ref_cells),
    c AS (SELECT cell_idx, {_type} AS k FROM (SELECT cell_idx, concat('t', CAST(label + 1 AS STRING)) AS cell_type FROM cells)), n AS (SELECT k,
    count(*) AS n FROM r GROUP BY 1)
    SELECT cell_idx, cell_id AS ref_cell FROM c JOIN n ON n.k = c.k JOIN r ON r.k = c.k AND r.draw = {_H('cell_idx', 1)} % n""")
register("p7_pseudo_spot_cells", lambda t: sampling.draw_pseudo_spots(t.cells, 500, 20), "cells",
    f", o AS (SELECT cell_idx, row_number() OVER (ORDER BY {_H('cell_idx', 0)}, cell_idx) - 1 AS draw FROM cells) SELECT i // 20 AS spot, i % 20 AS slot, "
    f"cell_idx FROM (SELECT unnest(range(10000)) AS i) JOIN o ON o.draw = {_H('i', 1)} % (SELECT count(*) FROM cells)")
register("a15_pseudo_spot_counts", lambda t: sampling.pseudo_spot_counts(t.cells.select((F.col("cell_idx") % 300).alias("spot"), F.concat(F.lit("r"),
    F.col("cell_idx") % 2000).alias("cell_id")), t.ref_expression, "cell_id"), "cells ref_expression",
    "SELECT cell_idx % 300 AS spot, gene, sum(count) AS count FROM cells JOIN ref_expression ON cell_id = concat('r', cell_idx % 2000) GROUP BY ALL")
