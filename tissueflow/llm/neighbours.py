"""Operator 8, approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and their two halves quantised apart, so CELLS x CELLS cells cost two small
codebooks. A query walks the cells by the sum of its two half distances with a heap (the multi-sequence walk)
until it has seen a share PROBED of all vectors (MIN_SEEN at least, so that there are k); the sum at which it stops says
which cells it probes. Their entries are reranked by exact cosine in double precision on the original vectors.

The codebooks come from a bounded sample (SAMPLE vectors); every vector is indexed. Vectors are shuffled once, by GROUPS of
neighbouring first halves, with a salt that splits a group into chunks of CHUNK vectors. Queries come as packs of up to PACK
for each group that they probe, with no more than their vector and their stopping sum; a chunk and a pack meet in one task, the
distances to the cells are taken from the codebooks there, and only each query's best k come out of it.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part; equal scores go to the smaller id; a repeated id counts once for each row; a query's
own id is never its neighbour; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CELLS = 512
SAMPLE = 20_000
PROBED, MIN_SEEN = 0.2, 10
GROUPS, CHUNK, PACK = 32, 4096, 512
WALKS = 64


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array<double>) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and size(v) > 0").filter(finite & F.exists("v", lambda x: x != 0))
    lengths = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return d.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows of the sample; rows of the book follow its main direction, so near ones are alike."""
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres[np.argsort(centres @ np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0], kind="stable")] if centres.size else centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]


def _array(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1)


def fit(vectors: DataFrame, cells: int = CELLS, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Both codebooks, from the size vectors that come first by a hash of their id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(size).select("v").collect()
    if not rows:
        return np.zeros((1, 0)), np.zeros((1, 0))
    x = _unit(np.array([r["v"] for r in rows]))
    half = x.shape[1] // 2
    return codebook(x[:, :half], cells), codebook(x[:, half:], cells)


def _coded(vectors: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_array(batch.column(1), batch.num_rows))
                half = books[0].shape[1]
                a, b = _distances(x[:, :half], books[0]).argmin(axis=1), _distances(x[:, half:], books[1]).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["id", "v", "a", "b"])

    return vectors.mapInArrow(run, "id long, v array<double>, a int, b int")


def _to_cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Squared distances of both halves of some vectors to all rows of the books, the same numbers whatever the vectors beside them."""
    halves = x[:, : books[0].shape[1]], x[:, books[0].shape[1] :]
    return [(c * c).sum(axis=1)[None, :] - 2 * np.einsum("id,jd->ij", h, c, optimize=False) for h, c in zip(halves, books, strict=True)]


def walk(da: np.ndarray, db: np.ndarray, counts: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Cells in ascending order of da + db, until they hold enough vectors: the multi-sequence walk."""
    oa, ob = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
    sa, sb = da[oa].tolist(), db[ob].tolist()
    # one open cell of each first half; the next half opens with its first cell
    heap, got, out = [(sa[0] + sb[0], 0, 0)], 0, []
    while heap and got < enough:
        _, i, j = heap[0]
        if j + 1 < len(sb):
            heapq.heapreplace(heap, (sa[i] + sb[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
        n = counts[oa[i], ob[j]]
        if n:
            out.append((oa[i], ob[j]))
            got += n
    return out


def _groups(a: np.ndarray, cells: int) -> np.ndarray:
    return a * GROUPS // max(1, cells)


def _probes(queries: DataFrame, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, enough: float) -> DataFrame:
    """query, v, stop, g: a row for each group that holds a cell whose sum is at most stop."""
    shared = queries.sparkSession.sparkContext.broadcast(counts)  # CELLS * CELLS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_array(batch.column(1), batch.num_rows))
            da, db = _to_cells(x, books)
            at, stops, groups = [], [], []
            for q in range(len(x)):
                i, j = walk(da[q], db[q], shared.value, enough)[-1]
                stop = da[q, i] + db[q, j]
                held = np.unique(_groups(np.flatnonzero(da[q] + db[q].min() <= stop), len(books[0])))
                at.append(np.full(len(held), q))
                stops.append(np.full(len(held), stop))
                groups.append(held)
            take = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(stops)), pa.array(np.concatenate(groups).astype(np.int32))], names=["query", "v", "stop", "g"])

    return queries.mapInArrow(run, "query long, v array<double>, stop double, g int")


def _packed(frame: DataFrame, keys: list[str], prefix: str, names: list[str]) -> DataFrame:
    """The rows of each group as one row of arrays; salts in keys bound the groups."""
    return frame.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("rows")).select(*keys, *[F.col(f"rows.{n}").alias(f"{prefix}_{n}") for n in names])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", probed: float = PROBED, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (is_query is over the column id)."""
    rows = valid(vectors, id_col, vector_col)
    books = fit(rows, cells)
    coded = written(_coded(rows, books), "coded-vectors")
    count = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    found = coded.groupBy("a", "b").count().toArrow()  # at most CELLS * CELLS rows
    count[found["a"].to_numpy(), found["b"].to_numpy()] = found["count"].to_numpy()
    enough = max(MIN_SEEN, 2 * k, probed * count.sum())
    size = np.bincount(_groups(np.arange(len(count)), len(count)), weights=count.sum(axis=1), minlength=GROUPS)
    g = F.floor(F.col("a") * GROUPS / len(count)).cast("int")
    chunks = F.element_at(F.array(*[F.lit(int(-(-max(1, n) // CHUNK))) for n in size]), F.col("g") + 1)
    held = coded.withColumn("g", g).withColumn("chunk", F.pmod(F.xxhash64("id"), chunks))
    held = _packed(held, ["g", "chunk"], "x", ["id", "v", "a", "b"])
    queries = coded.filter(is_query).select("id", "v").dropDuplicates(["id"])
    total = queries.count()
    # a walk is the work of some ten milliseconds, so few queries to a task
    probes = _probes(queries.repartition(max(1, -(-total // WALKS))), books, count, enough).withColumn("pack", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-total // (PACK // 2))))))
    packs = _packed(probes, ["g", "pack"], "q", ["query", "v", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x_id, x_a, x_b, q_id, stop = (np.asarray(batch.column(c)[i].values) for c in (0, 2, 3, 4, 6))
                x, q = (np.stack([np.asarray(v.values) for v in batch.column(c)[i].values]) for c in (1, 5))
                da, db = _to_cells(_unit(q), books)
                x, q = _tamed(x), _tamed(q)
                norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
                out = []
                for j in range(len(q)):
                    at = np.flatnonzero((da[j][x_a] + db[j][x_b] <= stop[j]) & (x_id != q_id[j]))
                    score = np.einsum("id,jd->ij", q[j : j + 1], x[at], optimize=False)[0] / (q_norm[j] * norm[at])
                    if len(at) > k:
                        near = score >= np.partition(score, len(at) - k)[len(at) - k]
                        at, score = at[near], score[near]
                    order = np.lexsort((x_id[at], -score))[:k]
                    out += [(int(q_id[j]), int(x_id[at[t]]), float(score[t])) for t in order]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    met = held.join(packs, "g").select("x_id", "x_v", "x_a", "x_b", "q_query", "q_v", "q_stop")
    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tamed(x: np.ndarray) -> np.ndarray:
    """Rows of extreme size scaled by a power of two, which changes no cosine."""
    e = np.frexp(np.abs(x).max(axis=1))[1]
    return np.ldexp(x, -np.where(np.abs(e) > 300, e, 0)[:, None])


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each sum in one order whatever the block."""
    q, x = _tamed(q), _tamed(x)
    dot = np.einsum("id,jd->ij", q, x, optimize=False)
    return dot / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :])


def brute_force(ids: np.ndarray, v: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The exact answer, for measuring recall on small tables."""
    rows = []
    for q in queries:
        s = _cosines(v[ids == q][:1], v)[0]
        s[ids == q] = -np.inf
        at = np.lexsort((ids, -s))[:k]
        rows += [(int(q), r + 1, int(ids[t]), float(s[t])) for r, t in enumerate(at) if np.isfinite(s[t])]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])
