"""Places and running values in the order of a whole table, without a task for a whole group.

Rows are dealt in ranges of their group and order, so a group of any size spreads over many tasks. One pass over each sorted range
notes what stood before a row in that range. What the earlier ranges of its group held is then one row for each range
and group: these are summed in order and joined to the rows (segmented prefix scan). No window is over rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tissueflow.sources.store import written

_OWN = ["_id", "_range"]


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str] | None = None, before: Mapping[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """df as a written table in ranges of by and order, each row with _range and _id (in order within it).

    sums: for each name a column of whole numbers, of which the rows before in the range are summed. before: for each name a column, of which
    the value in the row before in the range is kept. order must tell the rows of a group apart, or equal ones are in any order.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_id", F.monotonically_increasing_id())
    sums, before = dict(sums or {}), dict(before or {})
    if sums or before:
        names = d.columns
        schema = StructType([*d.schema.fields, *[StructField(s, LongType()) for s in sums], *[StructField(s, d.schema[c].dataType) for s, c in before.items()]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, last = dict.fromkeys(sums, 0), {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = list(batch.columns)
                for name, c in sums.items():
                    x = batch.column(names.index(c)).cast(pa.int64()).fill_null(0).to_numpy()
                    upto = total[name] + np.cumsum(x)
                    columns.append(pa.array(upto - x))
                    total[name] = int(upto[-1])
                for name, c in before.items():
                    x = batch.column(names.index(c))
                    first = last.get(name, pa.nulls(1, x.type))
                    columns.append(pa.concat_arrays([first, x.slice(0, len(x) - 1)]))
                    last[name] = x.slice(len(x) - 1, 1)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        d = d.mapInArrow(run, schema)
    return written(d, "ranged").withColumn("_range", F.shiftrightunsigned("_id", 33))


def _applied(t: DataFrame, per: DataFrame, by: Sequence[str], found: Sequence[str]) -> DataFrame:
    """t with the columns found of per, which has a row for each range and group."""
    per = per.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], *found)
    same = reduce(lambda a, b: a & b, [t["_range"] == per["_r"], *[t[c].eqNullSafe(per[f"_by{k}"]) for k, c in enumerate(by)]])
    return t.join(per, same).drop("_r", *[f"_by{k}" for k in range(len(by))])


def _earlier(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def placed(t: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """t with name, the row's place (from 0) in its group."""
    per = t.groupBy("_range", *by).agg(F.min("_id").alias("_lo"), F.count("*").alias("_n"))
    per = per.withColumn("_more", F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0)) - F.col("_lo"))
    return _applied(t, per, by, ["_more"]).withColumn(name, F.col("_id") + F.col("_more")).drop("_more")


def running(t: DataFrame, by: Sequence[str], column: str, summed: str, name: str) -> DataFrame:
    """t with name, the sum of column over the rows before in the group; summed is what ranged() made of column."""
    per = t.groupBy("_range", *by).agg(F.min_by(summed, "_id").alias("_lo"), F.sum(column).alias("_n"))
    per = per.withColumn("_more", F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0)) - F.col("_lo"))
    return _applied(t, per, by, ["_more"]).withColumn(name, F.col(summed) + F.col("_more")).drop("_more")


def preceding(t: DataFrame, by: Sequence[str], column: str, kept: str, name: str) -> DataFrame:
    """t with name, the column of the row before in the group (none: null); kept is what ranged() made of column."""
    per = t.groupBy("_range", *by).agg(F.min("_id").alias("_lo"), F.max_by(column, "_id").alias("_last"))
    per = per.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*by).orderBy("_range")))
    first = F.col("_id") == F.col("_lo")
    return _applied(t, per, by, ["_lo", "_carried"]).withColumn(name, F.when(first, F.col("_carried")).otherwise(F.col(kept))).drop("_lo", "_carried")


def plain(t: DataFrame, *more: str) -> DataFrame:
    """t without the columns of this module, and without more."""
    return t.drop(*_OWN, *more)
