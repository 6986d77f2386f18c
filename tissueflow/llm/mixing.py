"""Operator 10, mixing sources to target weights by Pareto order sampling.

Each source's target in words comes from its weight (water filling under a cap), certain whole copies of every
document are allotted first, and the rest is a Pareto order sample: documents in ascending order of random odds
divided by inclusion odds, until their words reach what is left of the target.

The cut in that order is found without sorting a source in one task: words are summed in BINS steps of the rank,
and only the step that holds the cut is put in order.

Defined results: a null text has size 0; null sources are one source, last in order; rows alike in doc_id and
text share their random number and are taken together; an empty table gives an empty result. In mixed(), columns of docs
that clash with the added names are replaced; repeated() returns every column of docs as it was, whatever its name. The
random numbers hash doc_id and text, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BINS = 1 << 14
#: A plan of up to so many sources is broadcast; beyond, Spark joins it as any table.
BROADCAST_SOURCES = 10_000
_WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, ratios: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size -> with target: L * weight below cap * source_size, all together share of all sizes.

    With sources in order of cap / weight, those that reach the cap are a prefix, so running sums give the level L.
    One row for each source comes here, never documents.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("key", "place").rowsBetween(Window.unboundedPreceding, -1)
    ratio = F.array(*[F.lit(float(r)) for r in ratios])
    s = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(ratio, ((F.col("place") - 1) % len(ratios) + 1).cast("int")))
    s = s.withColumn("most", cap * F.col("source_size").cast("double")).withColumn("key", F.col("most") / F.col("weight"))
    s = s.withColumn("all", share * F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    left = F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("capped", F.col("key") <= left / rest)
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    held = F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0.0))
    level = F.try_divide(F.col("all") - held, free)
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def _rank(inclusion: Column, seed: int) -> Column:
    """Pareto rank q = odds(U) / odds(inclusion), as q / (1 + q) so that it lies in [0, 1]."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    up, down = u * (1 - inclusion), (1 - u) * inclusion
    return F.when(inclusion <= 0, F.lit(1.0)).otherwise(up / (up + down))


def plan(docs: DataFrame, ratios: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 10, bins: int = BINS) -> DataFrame:
    """source, source_size, target, copies, inclusion, cut: a document gets copies and one more if its rank is at most cut."""
    sizes = written(docs.select("source", words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    s = targets(sizes, ratios, share, cap)
    expected = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    s = s.withColumn("copies", F.floor(expected)).withColumn("inclusion", expected - F.floor(expected))
    s = written(s.withColumn("need", F.col("inclusion") * F.col("source_size")), "source-targets")
    ranked = _joined(docs.select("doc_id", "text", "source"), s).select("source", "need", words(F.col("text")).alias("size"), _rank(F.col("inclusion"), seed).alias("rank"))
    ranked = written(ranked.filter("need > 0").withColumn("bin", F.floor(F.col("rank") * bins)), "ranks")
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    steps = ranked.groupBy("source", "bin").agg(F.sum("size").alias("size"), F.first("need").alias("need")).withColumn("upto", F.sum("size").over(run))
    # the cut lies in the first step that passes need; each step here is one row
    step = steps.filter("upto > need").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("base"))).alias("at")).select(F.col("source").alias("s"), F.col("at.bin").alias("b"), "at.base")
    inside = ranked.join(step, ranked.source.eqNullSafe(step.s) & (ranked.bin == step.b))
    inside = inside.groupBy("source", "bin", "base", "need", "rank").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    taken = inside.withColumn("upto", F.col("base") + F.sum("size").over(order)).withColumn("taken", F.col("upto") - F.col("size") / 2 <= F.col("need"))
    cut = taken.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("taken"), F.col("rank"))), F.min(F.col("bin") / F.lit(float(bins))) - 1e-12).alias("cut")).withColumnRenamed("source", "s")
    out = s.join(cut, s.source.eqNullSafe(cut.s), "left")
    # no step passes need: rounding alone, the whole source goes
    return out.select("source", "source_size", "target", "copies", "inclusion", F.when(F.col("need") <= 0, F.lit(-1.0)).otherwise(F.coalesce("cut", F.lit(1.0))).alias("cut"))


def _joined(docs: DataFrame, by_source: DataFrame) -> DataFrame:
    small = by_source.withColumnRenamed("source", "_source")
    if by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    return docs.join(small, docs["source"].eqNullSafe(small["_source"])).drop("_source")


def mixed(docs: DataFrame, ratios: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 10) -> DataFrame:
    """docs with size, source_size, target, times (how often the mix has the document) and taken = times * size."""
    p = written(plan(docs, ratios, share, cap, seed), "mix-plan")
    out = _joined(docs.drop("source_size", "target", "copies", "inclusion", "cut", "times", "taken", "size"), p)
    out = out.withColumn("size", words(F.col("text")))
    more = F.when((F.col("inclusion") > 0) & (_rank(F.col("inclusion"), seed) <= F.col("cut")), 1).otherwise(0)
    out = out.withColumn("times", (F.col("copies") + more).cast("long"))
    return out.withColumn("taken", F.col("times") * F.col("size")).drop("copies", "inclusion", "cut")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    own = [c if c in ("doc_id", "text", "source") else f"_column{k}" for k, c in enumerate(docs.columns)]  # no clash with added names
    taken = mixed(docs.toDF(*own), **options).filter("times > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return taken.select(*own).toDF(*docs.columns)
