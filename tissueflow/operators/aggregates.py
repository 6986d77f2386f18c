"""User aggregates over the values of a gene in a group of cells, zeros included, in bounded memory.

An aggregate is four steps over a state: update with some non-zero values, merge of two states, zeros for a number of
cells without a value, and finish. States are made where the counts lie and merged by group and gene, so a group of any size needs no more memory
than a batch and its states.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: States that a task holds before it hands them on.
HELD = 50_000


class Aggregate(Protocol):
    """What a user aggregate offers. States must be picklable and of bounded size."""

    def init(self) -> Any: ...
    def update(self, state: Any, values: np.ndarray) -> Any: ...
    def zeros(self, state: Any, n: int) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> float | None: ...


class Moments:
    """Mean, variance (ddof 1) or deviation, merged by counts, means and sums of squares about the mean."""

    def __init__(self, what: str = "mean"):
        if what not in ("mean", "variance", "deviation"):
            raise ValueError(f"no such moment: {what}")
        self.what = what

    def init(self) -> tuple[int, float, float]:
        return 0, 0.0, 0.0

    def update(self, state: tuple, values: np.ndarray) -> tuple:
        m = float(values.mean())
        return self.merge(state, (len(values), m, float(((values - m) ** 2).sum())))

    def zeros(self, state: tuple, n: int) -> tuple:
        return self.merge(state, (n, 0.0, 0.0))

    def merge(self, a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        if not a[0] or not b[0]:
            return a if a[0] else b
        d = b[1] - a[1]
        return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n

    def finish(self, state: tuple) -> float | None:
        n, mean, squares = state
        if self.what == "mean":
            return mean if n else None
        v = squares / (n - 1) if n > 1 else None
        return v if v is None or self.what == "variance" else float(np.sqrt(v))


class Spread:
    """Largest less smallest value."""

    def init(self) -> tuple[float, float]:
        return float("inf"), float("-inf")

    def update(self, state: tuple, values: np.ndarray) -> tuple:
        return self.merge(state, (float(values.min()), float(values.max())))

    def zeros(self, state: tuple, n: int) -> tuple:
        return self.merge(state, (0.0, 0.0)) if n else state

    def merge(self, a: tuple, b: tuple) -> tuple:
        return min(a[0], b[0]), max(a[1], b[1])

    def finish(self, state: tuple) -> float | None:
        return state[1] - state[0] if state[0] <= state[1] else None


class MeanOfLargest:
    """Mean of the n largest values (of all, if fewer)."""

    def __init__(self, n: int):
        self.n = n

    def init(self) -> np.ndarray:
        return np.zeros(0)

    def update(self, state: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self.merge(state, values)

    def zeros(self, state: np.ndarray, n: int) -> np.ndarray:
        return self.merge(state, np.zeros(min(n, self.n)))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([a, b]))[-self.n :]

    def finish(self, state: np.ndarray) -> float | None:
        return float(state.mean()) if len(state) else None


class OfAll:
    """Any function of all values at once. Its state holds them, so memory grows with the cells of a group: for small groups."""

    def __init__(self, function: Callable[[np.ndarray], float]):
        self.function = function

    def init(self) -> np.ndarray:
        return np.zeros(0)

    def update(self, state: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.concatenate([state, values])

    def zeros(self, state: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([state, np.zeros(n)])

    merge = update

    def finish(self, state: np.ndarray) -> float:
        return float(self.function(np.sort(state)))


def aggregated(values: DataFrame, keys: Sequence[str], n_cells: str, value: str, aggregates: Mapping[str, Aggregate]) -> DataFrame:
    """keys and a column for each aggregate of the non-zero values of a group; the other cells of its n_cells are zeros."""
    keys, kinds = list(keys), list(aggregates.values())
    d = values.select(F.to_json(F.struct(*keys)).alias("_group"), F.col(n_cells).cast("long").alias("_cells"), F.col(value).cast("double").alias("_value"), *keys)
    own = [d.schema[k] for k in keys]
    parts = StructType([StructField("_group", StringType()), StructField("_cells", LongType()), StructField("_n", LongType()), StructField("_states", BinaryType()), *own])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def handed_on() -> pa.RecordBatch:
            rows = pa.concat_tables([pa.Table.from_batches([h[3]]) for h in held.values()]).combine_chunks()
            columns = [pa.array(list(held)), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1] for h in held.values()], pa.int64()), pa.array([pickle.dumps(h[2]) for h in held.values()], pa.binary())]
            columns += [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=parts.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            codes, x = coded.indices.to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(codes[order]) > 0))
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                at, group = int(order[a]), coded.dictionary[int(codes[order[a]])].as_py()
                if group not in held:
                    one = pa.RecordBatch.from_arrays([c.take(pa.array([at])) for c in batch.columns[3:]], names=keys)
                    held[group] = [batch.column(1)[at].as_py(), 0, [f.init() for f in kinds], one]
                h, v = held[group], x[order[a:b]]
                h[1] += len(v)
                h[2] = [f.update(s, v) for f, s in zip(kinds, h[2], strict=True)]
            if len(held) >= HELD:
                yield handed_on()
        if held:
            yield handed_on()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def result() -> pa.RecordBatch:
            cells, n, states, one = held
            ends = [f.finish(f.zeros(s, cells - n)) for f, s in zip(kinds, states, strict=True)]
            return pa.RecordBatch.from_arrays([*one.columns, *[pa.array([e], pa.float64()) for e in ends]], names=[*keys, *aggregates])

        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                group, states = batch.column(0)[r].as_py(), pickle.loads(batch.column(3)[r].as_py())
                if group != now:
                    if now is not None:
                        out.append(result())
                    now, held = group, [batch.column(1)[r].as_py(), 0, [f.init() for f in kinds], batch.slice(r, 1).select(keys)]
                held[1] += batch.column(2)[r].as_py()
                held[2] = [f.merge(a, b) for f, a, b in zip(kinds, held[2], states, strict=True)]
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if now is not None:
            yield result()

    d = d.mapInArrow(partial, parts).repartition("_group").sortWithinPartitions("_group")
    return d.mapInArrow(whole, StructType([*own, *[StructField(name, DoubleType()) for name in aggregates]]))
