"""Geometry of spots and cells. Every distance join is an equi-join on grid bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.sources.store import written

# A patch of 72 pixels at a quarter micron a pixel.
PATCH, PATCH_MICRONS = 72, 0.25
#: Offsets of the six neighbours on a hexagonal lattice of array_row and array_col.
HEX = [(0, -2), (0, 2), (-1, -1), (-1, 1), (1, -1), (1, 1)]


def patch_boxes(cells: DataFrame, slide_meta: DataFrame) -> DataFrame:
    """Whole-pixel left, top and size of each cell's patch, for patches inside the slide."""
    size = PATCH * (PATCH_MICRONS / F.col("pixel_size"))
    d = cells.join(slide_meta, "sample_id").withColumn("size", size)
    d = d.withColumn("left", F.col("x") - F.floor(F.col("size") / 2)).withColumn("top", F.col("y") - F.floor(F.col("size") / 2))
    inside = (F.col("left") + F.col("size") >= 0) & (F.col("left") < F.col("width")) & (F.col("top") + F.col("size") >= 0) & (F.col("top") < F.col("height"))
    return d.filter(inside).select(*cells.columns, F.col("left").cast("int").alias("left"), F.col("top").cast("int").alias("top"), F.col("size").cast("int").alias("size"))


def spot_radius(spot_diameter: float, pixel_size: float) -> float:
    return 0.5 * spot_diameter / pixel_size


def radius_join(cells: DataFrame, spots: DataFrame, r: float) -> DataFrame:
    """cells with spot_id: of the spots at most r away, the one of highest spot_pos; null if there is none.

    Spots are put in the nine bins around theirs and gathered by bin (as many as lie within a few radii), so each
    cell meets one row: one join, no shuffle after it, and no grouping by cell.
    """
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    s = spots.select("sample_id", "spot_pos", "spot_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    s = s.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    s = s.withColumn("bx", F.floor(F.col("sx") / r) + F.col("dx")).withColumn("by", F.floor(F.col("sy") / r) + F.col("dy"))
    bins = s.groupBy("sample_id", "bx", "by").agg(F.collect_list(F.struct("spot_pos", "spot_id", "sx", "sy")).alias("near_spots"))
    c = cells.drop("spot_id").withColumn("bx", F.floor(F.col("x") / r)).withColumn("by", F.floor(F.col("y") / r))
    c = c.join(bins, ["sample_id", "bx", "by"], "left")
    hit = F.array_max(F.filter("near_spots", lambda p: (p["sx"] - F.col("x")) ** 2 + (p["sy"] - F.col("y")) ** 2 <= r * r))
    return c.withColumn("spot_id", hit["spot_id"]).drop("bx", "by", "near_spots")


def coverage(assigned: DataFrame, spots: DataFrame) -> DataFrame:
    """Per sample: cells, matched cells, their percentage, spots with a cell, and all spots."""
    d = assigned.groupBy("sample_id").agg(F.count("*").alias("n_cells"), F.count("spot_id").alias("n_matched"), F.count_distinct("spot_id").alias("n_spots_with_cells"))
    return d.join(spots.groupBy("sample_id").agg(F.count("*").alias("n_spots")), "sample_id").withColumn("percent", 100.0 * F.col("n_matched") / F.col("n_cells"))


def spot_cell_lists(assigned: DataFrame) -> DataFrame:
    """The sorted cells of each spot that has any."""
    return assigned.filter("spot_id is not null").groupBy("sample_id", "spot_id").agg(F.sort_array(F.collect_list("cell_idx")).alias("cells"))


def cells_per_spot(spots: DataFrame, assigned: DataFrame) -> DataFrame:
    """spots with their number of cells; null where there is none."""
    n = assigned.filter("spot_id is not null").groupBy("sample_id", "spot_id").agg(F.count("*").alias("n_cells"))
    return spots.join(n, ["sample_id", "spot_id"], "left")


def bags(expression: DataFrame, assigned: DataFrame) -> DataFrame:
    """Spots that have both counts and cells, with their sorted cells."""
    return spot_cell_lists(assigned).join(expression.select("sample_id", "spot_id"), ["sample_id", "spot_id"], "left_semi")


def bag_coverage(expression: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per sample: spots with counts, spots with cells, spots with both, and both as shares of each."""
    e = expression.select("sample_id", "spot_id").distinct().withColumn("e", F.lit(1))
    c = assigned.filter("spot_id is not null").select("sample_id", "spot_id").distinct().withColumn("c", F.lit(1))
    d = e.join(c, ["sample_id", "spot_id"], "full").groupBy("sample_id").agg(F.count("e").alias("n_expression"), F.count("c").alias("n_cells"), F.count_if(F.col("e").isNotNull() & F.col("c").isNotNull()).alias("n_both"))
    return d.withColumn("of_expression", F.try_divide("n_both", "n_expression")).withColumn("of_cells", F.try_divide("n_both", "n_cells"))


def hex_neighbours(spots: DataFrame) -> DataFrame:
    """sample_id, src, dst: the six neighbours on the lattice, by equality on shifted lattice places."""
    steps = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in HEX])
    a = spots.select("sample_id", F.col("spot_id").alias("src"), "array_row", "array_col", F.explode(steps).alias("s"))
    a = a.select("sample_id", "src", (F.col("array_row") + F.col("s.r")).alias("array_row"), (F.col("array_col") + F.col("s.c")).alias("array_col"))
    return a.join(spots.select("sample_id", F.col("spot_id").alias("dst"), "array_row", "array_col"), ["sample_id", "array_row", "array_col"]).select("sample_id", "src", "dst")


def _binned(points: DataFrame, level: int) -> DataFrame:
    """points with bins of their sample's width times 2 ** level."""
    size = F.col("width") * float(2.0**level)
    return points.withColumn("bx", F.floor((F.col("x") - F.col("x0")) / size)).withColumn("by", F.floor((F.col("y") - F.col("y0")) / size))


def _first_level(points: DataFrame, most: int = 64, least: int = -20) -> int:
    """The coarsest level, from 0 down, at which no bin holds more than most points."""
    level = 0
    while level > least and (_binned(points, level).groupBy("sample_id", "bx", "by").count().agg(F.max("count")).first()[0] or 0) > most:
        level -= 1
    return level


def nearest_of_all(spots: DataFrame, n: int = 6) -> DataFrame:
    """sample_id, src, dst, d, k: the n nearest other spots of each spot of a sample (all, if fewer), ties by name.

    Grid bins double from round to round. A round looks at the nine bins around each open spot, beyond which everything is further than one bin: a spot
    whose n-th distance is no longer than that is done, and only the others go on. So dense places are done in small bins, and what
    is far from all others in a few rounds more. Spots without a place take no part.
    """
    box = spots.groupBy("sample_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.count("*").alias("size"))
    width = F.greatest(F.sqrt(2 * F.col("w") * F.col("h") / F.col("size")), 2 * F.greatest("w", "h") / F.col("size"))
    box = box.select("sample_id", "x0", "y0", F.greatest("w", "h").alias("extent"), F.when(width > 0, width).otherwise(1.0).alias("width"))
    points = written(spots.select("sample_id", "spot_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null").join(box, "sample_id"), "points")
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    by = Window.partitionBy("sample_id", "src").orderBy("d", "dst")
    level, open_, done = _first_level(points), points.select("sample_id", "spot_id"), []
    while True:
        binned = _binned(points, level)
        a = binned.join(open_, ["sample_id", "spot_id"], "left_semi").select("sample_id", F.col("spot_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by", "width", "extent")
        a = a.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumn("bx", F.col("bx") + F.col("dx")).withColumn("by", F.col("by") + F.col("dy")).drop("dx", "dy")
        b = binned.select("sample_id", F.col("spot_id").alias("dst"), "x", "y", "bx", "by")
        d = a.join(b, ["sample_id", "bx", "by"]).filter("src <> dst").withColumn("d", F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")))
        found = written(d.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= n).select("sample_id", "src", "dst", "d", "k", "width", "extent"), "neighbours")
        reach = F.col("width") * float(2.0**level)
        full = found.groupBy("sample_id", "src").agg(F.count("*").alias("n"), F.max("d").alias("most"), F.first("width").alias("width")).filter((F.col("n") >= n) & (F.col("most") <= reach)).select("sample_id", F.col("src").alias("spot_id"))
        ended = points.filter(F.col("extent") < reach).select("sample_id", "spot_id")  # nothing of the sample is further away
        over = full.union(ended).distinct()
        done.append(found.join(over.withColumnRenamed("spot_id", "src"), ["sample_id", "src"], "left_semi").select("sample_id", "src", "dst", "d", "k"))
        open_ = written(open_.join(over, ["sample_id", "spot_id"], "left_anti"), "open-spots")
        if open_.isEmpty():
            return reduce(DataFrame.union, done)
        level += 1


def nearest_neighbours(spots: DataFrame, n: int = 6, longest: float = 1.3) -> DataFrame:
    """sample_id, src, dst without lattice places: the n nearest, but for edges of longest times the sample's median or more."""
    d = nearest_of_all(spots, n)
    middle = d.groupBy("sample_id").agg(F.median("d").alias("m"))
    return d.join(middle, "sample_id").filter(F.col("d") < longest * F.col("m")).select("sample_id", "src", "dst")


def position_join(counts: DataFrame, positions: DataFrame) -> DataFrame:
    """Counts with the spot position that their '<x>x<y>' id names."""
    return counts.join(positions.withColumn("id", F.concat_ws("x", F.col("x").cast("int"), F.col("y").cast("int"))), "id")


def standardise_coordinates(spots: DataFrame) -> DataFrame:
    """Coordinates less their sample's mean, over its population deviation (none: null)."""
    s = spots.groupBy("sample_id").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    d = spots.join(s, "sample_id")
    return d.withColumn("x", F.try_divide(F.col("x") - F.col("mx"), F.col("sx"))).withColumn("y", F.try_divide(F.col("y") - F.col("my"), F.col("sy"))).drop("mx", "sx", "my", "sy")


def morans_i(expression: DataFrame, spots: DataFrame, edges: DataFrame) -> DataFrame:
    """sample_id, gene, i: Moran's I with row-standardised weights; genes without variance have null.

    z is dense, but sum w z_i z_j expands into sums over counts that are not zero, so only those are joined.
    """
    degree = edges.groupBy("sample_id", "src").agg(F.count("*").alias("deg"))
    e = edges.join(degree, ["sample_id", "src"]).withColumn("w", 1.0 / F.col("deg"))
    total = e.groupBy("sample_id").agg(F.sum("w").alias("sum_w"))
    into = e.groupBy("sample_id", F.col("dst").alias("spot_id")).agg(F.sum("w").alias("c"))
    per_spot = spots.select("sample_id", "spot_id").join(into, ["sample_id", "spot_id"], "left").join(degree.select("sample_id", F.col("src").alias("spot_id"), F.lit(1.0).alias("d")), ["sample_id", "spot_id"], "left").na.fill(0.0)
    x = expression.select("sample_id", "spot_id", "gene", F.col("count").alias("v")).filter("v <> 0")
    single = x.join(per_spot, ["sample_id", "spot_id"]).groupBy("sample_id", "gene").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.sum(F.col("v") * (F.col("c") + F.col("d"))).alias("s3"))
    there = x.join(e, (x.sample_id == e.sample_id) & (x.spot_id == e.src)).select(x.sample_id, "gene", "dst", "w", F.col("v").alias("vi"))
    pair = there.join(x.withColumnRenamed("spot_id", "dst"), ["sample_id", "dst", "gene"]).groupBy("sample_id", "gene").agg(F.sum(F.col("w") * F.col("vi") * F.col("v")).alias("s4"))
    n = spots.groupBy("sample_id").agg(F.count("*").alias("n"))
    d = single.join(pair, ["sample_id", "gene"], "left").join(n, "sample_id").join(total, "sample_id").withColumn("m", F.col("s1") / F.col("n"))
    top = F.coalesce("s4", F.lit(0.0)) - F.col("m") * F.col("s3") + F.col("m") * F.col("m") * F.col("sum_w")
    below = F.col("s2") - F.col("n") * F.col("m") * F.col("m")
    i = F.when(below > 1e-12 * F.col("s2"), F.col("n") / F.col("sum_w") * top / below)
    return d.select("sample_id", "gene", i.alias("i"))
