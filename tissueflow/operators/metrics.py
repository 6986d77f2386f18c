"""Scoring predictions against measured expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissueflow.functions.scalars import correlation_p_value, nb_log_prob
from tissueflow.operators.scans import plain, ranged, running
from tissueflow.sources.store import written


def _keys(*tables: DataFrame) -> list[str]:
    """What tells spots apart: sample and spot where all tables have both."""
    return [c for c in ("sample_id", "spot_id") if all(c in t.columns for t in tables)]


def align(truth: DataFrame, pred: DataFrame, obs: DataFrame) -> DataFrame:
    """spot_id (and sample_id, where all tables have it), gene, y, p for all spots and the genes that both tables have; absent rows are zeros and count."""
    keys = _keys(truth, pred, obs)
    shared = truth.select("gene").distinct().join(pred.select("gene").distinct(), "gene")
    every = obs.select(*keys).distinct().crossJoin(shared)
    t, p = (d.select(*keys, "gene", F.col("value").alias(c)) for d, c in ((truth, "y"), (pred, "p")))
    return every.join(t, [*keys, "gene"], "left").join(p, [*keys, "gene"], "left").na.fill(0.0, ["y", "p"])


def gene_overlap(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Numbers of genes measured, predicted and both."""
    t, p = truth.select("gene").distinct().withColumn("t", F.lit(1)), pred.select("gene").distinct().withColumn("p", F.lit(1))
    return t.join(p, "gene", "full").agg(F.count("t").alias("n_measured"), F.count("p").alias("n_predicted"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("n_both"))


def run_ranks(runs: DataFrame, by: Sequence[str], column: str, count: str, rank: str) -> DataFrame:
    """runs (a row for each group and value, with its count) with rank, the mean place (from 1) of the value's rows.

    The rows before a value are a running sum over ranges of groups and values, so a group of any size is the work of many tasks.
    """
    t = ranged(runs, by, [column], sums={"_upto": count})
    return plain(running(t, by, count, "_upto", "_before"), "_upto").withColumn(rank, F.col("_before") + (F.col(count) + 1) / 2.0).drop("_before")


def average_ranks(df: DataFrame, column: str, rank: str, by: str = "gene") -> DataFrame:
    """Ranks from 1 in each group; ties share their mean rank."""
    runs = df.groupBy(F.col(by).alias("_by"), F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    ranks = run_ranks(runs, ["_by"], "_value", "_n", rank)
    return df.join(ranks, df[by].eqNullSafe(ranks["_by"]) & df[column].eqNullSafe(ranks["_value"])).drop("_by", "_value", "_n")


def _scored(rows: DataFrame, per: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, pcc, scc, mse of each group of per (by, n, and what _moments gives); of its n pairs, rows has those that are not both zero, or more.

    Moments are merged (and so centred) by Spark, with the absent pairs as one more part. Ranks come from the counts of each value but zero, which
    shifts the larger ones. For the product of ranks only pairs without a zero meet the ranks of both sides: what the others add follows from sums over the
    values. rows and per are stored tables.
    """
    by = list(by)
    y, p, n = F.col("y"), F.col("p"), F.col("n")
    sides = [rows.filter(F.col(c) != 0).groupBy(*by, F.lit(c).alias("side"), F.col(c).alias("value")).agg(F.count("*").alias("c")) for c in ("y", "p")]
    ranks = run_ranks(sides[0].union(sides[1]), [*by, "side"], "value", "c", "rank").join(per.select(*by, "n", "ny", "np"), by)
    zeros = n - F.when(F.col("side") == "y", F.col("ny")).otherwise(F.col("np"))
    ranks = ranks.withColumn("r", F.col("rank") + F.when(F.col("value") > 0, zeros).otherwise(0) - (n + 1) / 2.0)
    of = lambda c, what: F.coalesce(F.sum(F.when(F.col("side") == c, what)), F.lit(0.0))
    r, c = F.col("r"), F.col("c")
    sums = ranks.groupBy(*by).agg(*[of(k, c * r * r).alias(f"s{k}") for k in ("y", "p")], *[of(k, c * r).alias(f"t{k}") for k in ("y", "p")])
    both = rows.filter((y != 0) & (p != 0))
    for k in ("y", "p"):
        both = both.join(ranks.filter(F.col("side") == k).select(*by, F.col("value").alias(k), F.col("r").alias(f"r{k}")), [*by, k])
    both = both.groupBy(*by).agg(F.sum(F.col("ry") * F.col("rp")).alias("ayp"), F.sum("ry").alias("ay"), F.sum("rp").alias("ap"))
    d = per.join(sums, by, "left").join(both, by, "left").na.fill(0.0, ["sy", "sp", "ty", "tp", "ayp", "ay", "ap"])
    # zeros of a side are one tie: the ranks of all its pairs sum to nothing, so theirs is what balances the others
    for k in ("y", "p"):
        d = d.withColumn(f"z{k}", F.coalesce(F.try_divide(-F.col(f"t{k}"), n - F.col(f"n{k}")), F.lit(0.0))).withColumn(f"s{k}", F.col(f"s{k}") + (n - F.col(f"n{k}")) * F.col(f"z{k}") * F.col(f"z{k}"))
    rank_product = F.col("ayp") + F.col("zp") * (F.col("ty") - F.col("ay")) + F.col("zy") * (F.col("tp") - F.col("ap")) + (n - F.col("ny") - F.col("np") + F.col("nyp")) * F.col("zy") * F.col("zp")
    k, absent = F.col("k"), n - F.col("k")
    spread = lambda v, a, b: k * F.col(v) + k * absent / n * F.col(a) * F.col(b)
    pearson = F.try_divide(spread("vyp", "my", "mp"), F.sqrt(spread("vy", "my", "my")) * F.sqrt(spread("vp", "mp", "mp")))
    flat = lambda c: (F.col(f"most_{c}") == F.col(f"least_{c}")) & ((absent == 0) | (F.col(f"most_{c}") == 0))
    varies = (k > 0) & ~flat("y") & ~flat("p")
    scores = F.when(varies, pearson).alias("pcc"), F.when(varies, F.try_divide(rank_product, F.sqrt("sy") * F.sqrt("sp"))).alias("scc")
    return d.select(*by, "n", *scores, F.coalesce(F.col("gap") / n, F.lit(0.0)).alias("mse"))


def _moments(use: Column | None = None) -> list[Column]:
    """What _scored needs of a group's rows (those that use keeps)."""
    y, p = ((F.col(c) if use is None else F.when(use, F.col(c))) for c in ("y", "p"))
    extremes = [f(c).alias(f"{o}_{name}") for name, c in (("y", y), ("p", p)) for o, f in (("least", F.min), ("most", F.max))]
    counts = [F.count(y).alias("k"), F.count_if(y != 0).alias("ny"), F.count_if(p != 0).alias("np"), F.count_if((y != 0) & (p != 0)).alias("nyp")]
    return [F.avg(y).alias("my"), F.avg(p).alias("mp"), F.var_pop(y).alias("vy"), F.var_pop(p).alias("vp"), F.covar_pop(y, p).alias("vyp"), F.sum((y - p) * (y - p)).alias("gap"), *extremes, *counts]


def regression_metrics(aligned: DataFrame, by: str = "gene") -> DataFrame:
    """by, pcc, scc, mse of aligned rows (by, y, p)."""
    rows = written(aligned.select(by, F.col("y").cast("double").alias("y"), F.col("p").cast("double").alias("p")), "aligned-rows")
    return _scored(rows, written(rows.groupBy(by).agg(F.count("*").alias("n"), *_moments()), "group-moments"), [by]).drop("n")


def _sparse_scores(truth: DataFrame, pred: DataFrame, obs: DataFrame, by: str) -> DataFrame:
    keys = _keys(truth, pred, obs)
    spots = obs.select(*keys).distinct()
    t, p = (d.select(*keys, "gene", F.col("value").cast("double").alias(c)) for d, c in ((truth, "y"), (pred, "p")))
    d = t.withColumn("t", F.lit(True)).join(p.withColumn("m", F.lit(True)), [*keys, "gene"], "full").na.fill(0.0, ["y", "p"])
    d = written(d.join(spots.withColumn("there", F.lit(True)), keys, "left"), "scored-rows")
    there = F.col("there").isNotNull()
    if by == "gene":
        per = d.groupBy("gene").agg(F.max("t").alias("t"), F.max("m").alias("m"), *_moments(there)).filter("t and m").drop("t", "m")
        per = written(per.crossJoin(F.broadcast(spots.agg(F.count("*").alias("n")))), "group-moments")
        return _scored(d.filter(there).join(per.select("gene"), "gene", "left_semi"), per, ["gene"])
    shared = written(d.groupBy("gene").agg(F.max("t").alias("t"), F.max("m").alias("m")).filter("t and m").select("gene"), "shared-genes")
    d = d.filter(there).join(shared, "gene", "left_semi")
    per = spots.join(d.groupBy(*keys).agg(*_moments()), keys, "left").na.fill(0, ["k", "ny", "np", "nyp"])
    return _scored(d, written(per.crossJoin(F.broadcast(shared.agg(F.count("*").alias("n")))), "group-moments"), keys)


def sparse_metrics(truth: DataFrame, pred: DataFrame, obs: DataFrame, by: str = "gene") -> DataFrame:
    """regression_metrics(align(truth, pred, obs), by) from the rows that there are; where both tables lack a row, both are zero.

    Every shared gene or every spot of obs has a row; spots are told apart by sample too, where all tables have it. A spot and gene stand at
    most once in a table.
    """
    return _sparse_scores(truth, pred, obs, by).drop("n")


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over genes; genes without a value are left out."""
    return metrics.agg(*[F.avg(m).alias(m) for m in ("pcc", "scc", "mse")])


def spot_correlation(aligned: DataFrame) -> DataFrame:
    """Pearson of each spot over its genes."""
    return regression_metrics(aligned, "spot_id").select("spot_id", "pcc")


def sparse_spot_correlation(truth: DataFrame, pred: DataFrame, obs: DataFrame) -> DataFrame:
    """spot_id (and sample_id, where all tables have it), pcc of each spot over the shared genes, and its two-sided p-value."""
    d = _sparse_scores(truth, pred, obs, "spot_id")
    return d.select(*_keys(d), "pcc", correlation_p_value(F.col("pcc"), F.col("n")).alias("p_value"))


def moments(batch: DataFrame) -> DataFrame:
    """Mergeable sums of a batch of aligned rows, by gene."""
    return batch.groupBy("gene").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum("p").alias("sp"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("p") * F.col("p")).alias("spp"), F.sum(F.col("y") * F.col("p")).alias("syp"))


def merged_metrics(parts: DataFrame) -> DataFrame:
    """gene, pcc, mse of all batches whose moments are stacked in parts."""
    d = parts.groupBy("gene").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "sp", "syy", "spp", "syp")])
    n, sy, sp, syy, spp, syp = (F.col(c) for c in ("n", "sy", "sp", "syy", "spp", "syp"))
    vy, vp = syy - sy * sy / n, spp - sp * sp / n
    ok = (vy > 1e-9 * syy) & (vp > 1e-9 * spp)
    return d.select("gene", F.when(ok, (syp - sy * sp / n) / (F.sqrt(vy) * F.sqrt(vp))).alias("pcc"), ((syy - 2 * syp + spp) / n).alias("mse"))


def nb_loss(df: DataFrame) -> DataFrame:
    """Negative log-likelihood of count under (mu, theta), summed over genes and averaged over spots."""
    d = df.withColumn("ll", nb_log_prob(F.col("count"), F.col("mu"), F.col("theta")))
    return d.groupBy(*_keys(d)).agg(F.sum("ll").alias("ll")).agg((-F.avg("ll")).alias("loss"))


def adjusted_rand_index(labels: DataFrame, a: str = "a", b: str = "b", leave_out: str = "undetermined") -> DataFrame:
    """ari of two labelings, over rows that neither calls leave_out; one cluster on both sides gives 1."""
    pairs = lambda c: c * (c - 1) / 2.0
    d = labels.filter((F.col(a) != leave_out) & (F.col(b) != leave_out)).groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    ra = d.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    rb = d.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    s = d.agg(F.sum(pairs(F.col("n"))).alias("sab"), F.sum("n").alias("n")).crossJoin(ra).crossJoin(rb)
    expected = F.try_divide(F.col("sa") * F.col("sb"), pairs(F.col("n")))
    return s.select(F.coalesce(F.try_divide(F.col("sab") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def long_metrics(wide: DataFrame, tag: str = "tag") -> DataFrame:
    """tag, gene, pcc, scc, mse from columns '<metric>/<gene>'; a gene may hold further slashes."""
    columns = [f"`{c}`" for c in wide.columns if c.split("/", 1)[0] in ("pcc", "scc", "mse") and "/" in c]
    d = wide.unpivot(tag, columns, "name", "value")
    slash = F.instr("name", "/")
    d = d.select(tag, F.substring(F.col("name"), F.lit(1), slash - 1).alias("metric"), F.substring(F.col("name"), slash + 1, F.length("name")).alias("gene"), "value")
    return d.groupBy(tag, "gene").pivot("metric", ["pcc", "scc", "mse"]).agg(F.first("value"))


def wide_metrics(metrics: DataFrame, genes: list[str], tag: str = "tag") -> DataFrame:
    """One row for each tag with columns '<metric>/<gene>'."""
    d = metrics.unpivot([tag, "gene"], ["pcc", "scc", "mse"], "metric", "value").withColumn("name", F.concat_ws("/", "metric", "gene"))
    return d.groupBy(tag).pivot("name", [f"{m}/{g}" for m in ("pcc", "scc", "mse") for g in genes]).agg(F.first("value"))


def metric_quartiles(runs: DataFrame, params: list[str], metric: str) -> DataFrame:
    """param, setting, n, least, q1, median, q3, most of a metric over gathered runs."""
    d = runs.select(F.col(metric).alias("m"), *[F.col(p).cast("string").alias(p) for p in params]).unpivot("m", params, "param", "setting")
    q = F.percentile("m", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = d.groupBy("param", "setting").agg(F.count("m").alias("n"), F.min("m").alias("least"), q.alias("q"), F.max("m").alias("most"))
    return d.select("param", "setting", "n", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "most")


def top_cells(expression: DataFrame, gene: str, n: int) -> DataFrame:
    """The n cells with the most of a gene."""
    return expression.filter(F.col("gene") == gene).orderBy(F.desc("count"), "cell_id").limit(n)


def top_genes(metrics: DataFrame, truth: DataFrame, pred: DataFrame, n: int = 10) -> DataFrame:
    """The n genes of best Spearman (to nine places; those without come last) that both tables have, ties by name."""
    d = metrics.join(truth.select("gene"), "gene", "left_semi").join(pred.select("gene"), "gene", "left_semi")
    return d.orderBy(F.round("scc", 9).desc_nulls_last(), "gene").limit(n)
