"""Jobs on embedding vectors, cell predictions and image patches."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tissueflow.functions.scalars import class_name, distance
from tissueflow.sources.store import written

#: Keys that a ball of the top-k match holds, or thereabouts.
KEY_BLOCK = 4096
#: Balls of keys at most, keys of a bucket of balls, and queries that one task matches with a bucket, the latter two roughly.
BALLS, BUCKET, QUERY_PACK = 1024, 16384, 16384
#: Rows that numpy takes at once, so that what a task holds does not grow with its batches: of balls and centres, and of queries and a bucket.
PLAN_SLICE, MATCH_SLICE = 512, 32
#: Images that a task holds as numbers at once.
IMAGE_SLICE = 64
# Patches of 72 x 72 colour pixels, of which the middle 48 x 48 count.
PATCH, CROP = 72, 48


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _stacked(vectors: pa.Array, n: int) -> np.ndarray:
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(n, -1)


def _with_direction(d: DataFrame) -> DataFrame:
    """Rows whose vector has a direction: no null or non-finite component, not all zero."""
    v = F.col("embedding")
    return d.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def ball_centres(keys: DataFrame, balls: int, sample: int = 64, rounds: int = 8) -> np.ndarray:
    """Unit centres by k-means on cosine over at most sample keys for each ball, those first in order of a hash."""
    rows = keys.orderBy(F.xxhash64("key_id"), "key_id").limit(sample * balls).select("embedding").collect()
    x = _units(np.array([r["embedding"] for r in rows], dtype=np.float64))
    centres = x[np.linspace(0, len(x) - 1, min(balls, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + PLAN_SLICE] @ centres.T).argmax(axis=1) for i in range(0, len(x), PLAN_SLICE)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(axis=1))
        centres = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], centres)
    return centres


def _in_balls(keys: DataFrame, centres: np.ndarray) -> DataFrame:
    """key_id, embedding, ball (of the nearest centre) and its cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PLAN_SLICE):
                batch = whole.slice(at, PLAN_SLICE)
                s = _units(_stacked(batch.column(1), batch.num_rows)) @ centres.T
                ball = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball.astype(np.int32)), pa.array(s[np.arange(len(s)), ball])], names=["key_id", "embedding", "ball", "cosine"])

    return keys.select(F.col("key_id").cast("long").alias("key_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "key_id long, embedding array<double>, ball int, cosine double")


def _buckets(sizes: Sequence[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and number of buckets of each ball: balls in turn share one until it has most keys; a ball of more has several of its own."""
    first, parts, at, held = [], [], 0, 0
    for n in sizes:
        own = -(-n // most)
        if held and (own > 1 or held + n > most):
            at, held = at + 1, 0
        first.append(at)
        parts.append(max(1, own))
        at, held = (at + own, 0) if own > 1 else (at, held + n)
    return np.array(first, dtype=np.int64), np.array(parts, dtype=np.int64)


def _planned(queries: DataFrame, centres: np.ndarray, widest: np.ndarray, buckets: tuple[np.ndarray, np.ndarray], first: int, last: int) -> DataFrame:
    """query_id, embedding, least, n, visits: of each query's balls in order of their bound, those from first to last that can hold a match above least.

    A ball whose members are at most widest (an angle) from its centre holds no cosine above that of the angle to the centre less widest. n counts the balls;
    visits names them by the buckets that hold them, so that a query's vector is in one row here, however many it visits. Queries without visits are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PLAN_SLICE):
                batch = whole.slice(at, PLAN_SLICE)
                q = _units(_stacked(batch.column(1), batch.num_rows))
                angle = np.arccos(np.clip(q @ centres.T, -1, 1))
                bound = np.cos(np.clip(angle - widest, 0, np.pi)) + 1e-9
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                ok = np.take_along_axis(bound, order, axis=1) >= batch.column(2).to_numpy()[:, None]
                n = ok.sum(axis=1)
                batch, order, ok, n = batch.take(pa.array(np.flatnonzero(n))), order[n > 0], ok[n > 0], n[n > 0]
                if not len(n):
                    continue
                row, place = np.nonzero(ok)
                ball = order[row, place]
                many = buckets[1][ball]
                row, ball, start = np.repeat(row, many), np.repeat(ball, many), np.repeat(np.cumsum(many) - many, many)
                bucket = buckets[0][ball] + np.arange(len(ball)) - start
                by = np.lexsort((ball, bucket, row))
                row, ball, bucket = row[by], ball[by], bucket[by]
                new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(bucket) != 0)])
                balls = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)].astype(np.int32)), pa.array(ball.astype(np.int32)))
                each = pa.StructArray.from_arrays([pa.array(bucket[new].astype(np.int32)), balls], names=["bucket", "balls"])
                visits = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(len(n) + 1)).astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), visits], names=["query_id", "embedding", "least", "n", "visits"])

    return queries.mapInArrow(run, "query_id long, embedding array<double>, least double, n long, visits array<struct<bucket int, balls array<int>>>")


def _best_of_slice(keys: tuple[np.ndarray, ...], batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """query_id, key_id, similarity: of the keys in the balls that a query visits, its best k that are no worse than least."""
    key_ids, ball, x = keys
    q_ids, least = batch.column("id").to_numpy(), batch.column("least").to_numpy()
    q = _units(_stacked(batch.column("embedding"), batch.num_rows))
    lists = batch.column("balls")
    visits = lists.flatten().to_numpy()
    some = np.unique(visits)
    wanted = np.isin(ball, some)
    if not wanted.all():
        key_ids, ball, x = key_ids[wanted], ball[wanted], x[wanted]
    seen = np.zeros((len(q), len(some)), dtype=bool)
    seen[np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), np.searchsorted(some, visits)] = True
    s = q @ x.T
    if not seen.all():
        s[~seen[:, np.searchsorted(some, ball)]] = -np.inf
    if (least < -1).any() and len(x) > k:  # no k-th best yet
        least = np.maximum(least, np.partition(s, len(x) - k, axis=1)[:, len(x) - k])
    row, at = np.nonzero(s >= np.maximum(least, -2)[:, None] - 1e-11)
    found = np.round(s[row, at], 12)  # so that equal keys tie
    order = np.lexsort((key_ids[at], -found, row))
    row, at, found = row[order], at[order], found[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q_ids)))[row]
    ok = rank < k
    return pa.RecordBatch.from_arrays([pa.array(q_ids[row[ok]]), pa.array(key_ids[at[ok]]), pa.array(found[ok])], names=["query_id", "key_id", "similarity"])


def _bucket_matches(keys: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """query_id, key_id, similarity: the best k keys of a bucket for each query that visits it.

    A task reads a bucket's keys, then its queries one slice after another, so it holds one bucket, however many queries come. Where these are
    more than QUERY_PACK, several tasks have the bucket.
    """
    asked = plan.select("query_id", "embedding", "least", F.explode("visits").alias("v")).select("v.bucket", "query_id", "embedding", "least", "v.balls")
    packs = plan.select(F.explode("visits.bucket").alias("bucket")).groupBy("bucket").agg(F.ceil(F.count("*") / QUERY_PACK).cast("int").alias("packs"))
    asked = asked.join(F.broadcast(packs), "bucket").withColumn("pack", F.pmod(F.xxhash64("query_id"), F.col("packs")).cast("int"))
    asked = asked.select("bucket", "pack", F.lit(1).alias("side"), F.col("balls")[0].alias("ball"), F.col("query_id").alias("id"), "embedding", "least", "balls")
    keys = keys.join(F.broadcast(packs), "bucket").withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
    keys = keys.select("bucket", "pack", F.lit(0).alias("side"), "ball", F.col("key_id").alias("id"), "embedding", F.lit(None).cast("double").alias("least"), F.lit(None).cast("array<int>").alias("balls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, held = None, [], None
        for whole in batches:
            if not whole.num_rows:
                continue
            bucket, pack, side = (whole.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(pack) != 0) | (np.diff(side) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                batch = whole.slice(start, end - start)
                if here != (bucket[start], pack[start]):
                    here, parts, held = (bucket[start], pack[start]), [], None
                if side[start] == 0:
                    parts.append((batch.column("id").to_numpy(), batch.column("ball").to_numpy(), _units(_stacked(batch.column("embedding"), batch.num_rows))))
                elif parts or held:
                    held = held or tuple(np.concatenate(c) for c in zip(*parts, strict=True))
                    parts = []
                    for at in range(0, batch.num_rows, MATCH_SLICE):
                        yield _best_of_slice(held, batch.slice(at, MATCH_SLICE), k)

    rows = keys.union(asked).repartition("bucket", "pack").sortWithinPartitions("bucket", "pack", "side", "ball", "id")
    return rows.mapInArrow(run, "query_id long, key_id long, similarity double")


def top_matches(queries: DataFrame, keys: DataFrame, k: int, block: int = KEY_BLOCK, report: dict[str, int] | None = None) -> DataFrame:
    """query_id, key_id, similarity, rank: the k keys of highest cosine for each query, ties to the smaller id.

    Keys lie in balls of some block keys around at most BALLS centres, balls in buckets of some BUCKET keys. A query visits balls in the order of the highest
    cosine that they can hold, a few more in each round, until its k-th best reaches what the next ball can hold. It goes once to each bucket that holds some of
    a round's balls; a slice of queries and a bucket are one matrix product, of which only each query's best k leave the task. report gets the numbers of pairs
    of queries and balls there are and that were visited.
    """
    keys, queries = _with_direction(keys), _with_direction(queries)
    n_keys, n_queries = keys.count(), queries.count()
    empty = keys.sparkSession.createDataFrame([], "query_id long, key_id long, similarity double, rank int")
    if not n_keys or not n_queries:
        return empty
    centres = ball_centres(keys, max(1, min(BALLS, -(-n_keys // block))))
    held = written(_in_balls(keys, centres), "keys-in-balls")
    sizes = {r["ball"]: r for r in held.groupBy("ball").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).collect()}  # BALLS rows at most
    full = sorted(sizes)
    centres, widest = centres[full], np.array([np.arccos(np.clip(sizes[b]["least"], -1, 1)) + 1e-7 for b in full])
    buckets = _buckets([sizes[b]["n"] for b in full], BUCKET)
    places = {"ball": full, "number": range(len(full)), "first": buckets[0], "parts": buckets[1]}
    places = keys.sparkSession.createDataFrame(pa.table({c: pa.array(v, pa.int32()) for c, v in places.items()}))  # of Arrow: a list would start Python workers
    held = held.join(F.broadcast(places), "ball").select("key_id", "embedding", F.col("number").alias("ball"),
        (F.col("first") + F.pmod(F.xxhash64("key_id"), F.col("parts"))).cast("int").alias("bucket"))
    asked = written(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")), "asked")
    best, first, step, visited = None, 0, 1, 0
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key_id")
    while first < len(full):
        least = asked.withColumn("least", F.lit(-2.0))
        if best is not None:
            kth = best.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("kth"))
            least = asked.join(kth, "query_id", "left").select("query_id", "embedding", F.coalesce("kth", F.lit(-2.0)).alias("least"))
        plan = written(_planned(least, centres, widest, buckets, first, first + step), "planned-visits")
        n = plan.agg(F.sum("n")).first()[0] or 0
        visited += n
        if n:
            found = _bucket_matches(held, plan, k)
            found = found if best is None else found.union(best.drop("rank"))
            best = written(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "best-matches")
        elif best is not None:
            break  # bounds descend: what follows can hold no more than this
        first, step = first + step, 4 * step
    if report is not None:
        report |= {"pairs": n_queries * len(full), "visited": visited}
    return empty if best is None else best


def match_weights(matches: DataFrame, queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Matches with weight 1 / squared distance of the vectors as they are; exact matches take all the weight."""
    d = matches.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(keys.select("key_id", F.col("embedding").alias("x")), "key_id")
    d = d.withColumn("d", distance(F.col("q"), F.col("x")))
    exact = F.min("d").over(Window.partitionBy("query_id")) == 0
    w = F.when(exact, F.when(F.col("d") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("d") * F.col("d")))
    return d.withColumn("weight", w).select("query_id", "key_id", "weight", "x")


def average_matched_expression(weights: DataFrame, expression: DataFrame) -> DataFrame:
    """query_id, gene, value: weighted mean of the matched keys' expression; absent rows are zero."""
    total = weights.groupBy("query_id").agg(F.sum("weight").alias("t"))
    s = weights.filter("weight > 0").join(expression, "key_id").groupBy("query_id", "gene").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    return s.join(total, "query_id").select("query_id", "gene", (F.col("s") / F.col("t")).alias("value"))


def average_matched_embedding(weights: DataFrame) -> DataFrame:
    """query_id, place, value: weighted mean of the matched keys' vectors, a row for each component."""
    d = weights.select("query_id", "weight", F.posexplode("x").alias("place", "v"))
    return d.groupBy("query_id", "place").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("value"))


def assemble_bags(bags: DataFrame, embeddings: DataFrame, size_factors: DataFrame) -> DataFrame:
    """Spots with their size factor and the vectors and labels of their cells, in cell order."""
    cells = bags.select("sample_id", "spot_id", F.explode("cells").alias("cell_idx")).join(embeddings, ["sample_id", "cell_idx"])
    out = cells.groupBy("sample_id", "spot_id").agg(F.array_sort(F.collect_list(F.struct("cell_idx", "label", "embedding"))).alias("instances"))
    return out.join(size_factors.select("sample_id", "spot_id", "size_factor"), ["sample_id", "spot_id"])


def cell_information(predictions: DataFrame, cells: DataFrame) -> DataFrame:
    """Per-cell predictions with barcode, label, class and place."""
    return predictions.join(cells.select("sample_id", "cell_idx", "barcode", "label", class_name(F.col("label")).alias("class"), "x", "y"), ["sample_id", "cell_idx"])


def _activate(x: np.ndarray, name: str) -> np.ndarray:
    if name == "relu":
        return np.maximum(x, 0)
    if name == "softplus":  # beta 20, linear where beta * x is over 20
        return np.where(20 * x > 20, x, np.log1p(np.exp(np.minimum(20 * x, 20))) / 20)
    if name == "sigmoid":
        return 1 / (1 + np.exp(-x))
    if name == "softmax":
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    if name == "identity":
        return x
    raise ValueError(f"no such activation: {name}")


def forward(x: np.ndarray, layers: Sequence[tuple[np.ndarray, np.ndarray]], activation: str, slope: float = 0.01) -> np.ndarray:
    """A perceptron: linear and leaky rectifier for all layers but the last, which is linear and activation."""
    for k, (w, b) in enumerate(layers):
        x = x @ w.T + b
        if k < len(layers) - 1:
            x = np.where(x > 0, x, slope * x)
    return _activate(x, activation)


def predict_cells(embeddings: DataFrame, layers: Sequence[tuple[np.ndarray, np.ndarray]], activation: str = "softplus") -> DataFrame:
    """embeddings with prediction (a vector over genes); weights are broadcast once, batches go through numpy."""
    held = embeddings.sparkSession.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in layers])

    @F.pandas_udf("array<double>")
    def predict(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(forward(np.stack([np.asarray(x, float) for x in v]), held.value, activation)))

    return embeddings.withColumn("prediction", predict("embedding"))


def bag_means(predictions: DataFrame, genes: Sequence[str]) -> DataFrame:
    """sample_id, spot_id, gene, value: vectors are averaged by spot before genes become rows."""
    parts = [F.avg(F.col("prediction")[k]).alias(f"_{k}") for k in range(len(genes))]
    d = predictions.filter("spot_id is not null").groupBy("sample_id", "spot_id").agg(*parts)
    pairs = F.array(*[F.struct(F.lit(g).alias("gene"), F.col(f"_{k}").alias("value")) for k, g in enumerate(genes)])
    return d.select("sample_id", "spot_id", F.explode(pairs).alias("p")).select("sample_id", "spot_id", "p.gene", "p.value")


def bag_nb_means(means: DataFrame, size_factors: DataFrame) -> DataFrame:
    """Bag mean times the spot's size factor."""
    d = means.join(size_factors.select("sample_id", "spot_id", "size_factor"), ["sample_id", "spot_id"])
    return d.withColumn("mu", F.col("value") * F.col("size_factor"))


def cluster_embeddings(embeddings: DataFrame, k: int = 6, dims: int = 50, seed: int = 0) -> DataFrame:
    """id, cluster and distances to all centres, by PCA and seeded k-means."""
    d = embeddings.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    d = PCA(k=dims, inputCol="_v", outputCol="_p").fit(d).transform(d).persist()
    model = KMeans(k=k, seed=seed, featuresCol="_p", predictionCol="cluster").fit(d)
    d.unpersist()
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    p = vector_to_array("_p")
    return model.transform(d).withColumn("distances", F.transform(centres, lambda c: distance(p, c))).drop("_v", "_p")


def nearest_to_own_centre(clustered: DataFrame, n: int, key: str = "cell_idx") -> DataFrame:
    """The n cells of each cluster nearest to its centre."""
    own = F.element_at("distances", F.col("cluster") + 1)
    w = Window.partitionBy("cluster").orderBy("distance", key)
    return clustered.withColumn("distance", own).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def nearest_to_each_centre(clustered: DataFrame, n: int, key: str = "cell_idx") -> DataFrame:
    """The n cells nearest to each centre among all cells."""
    d = clustered.select(key, F.posexplode("distances").alias("centre", "distance"))
    w = Window.partitionBy("centre").orderBy("distance", key)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def cluster_counts(cells: DataFrame) -> DataFrame:
    """Cells by cluster, class and slide."""
    return cells.groupBy("cluster", "class", "sample_id").agg(F.count("*").alias("n"))


def medoid_types(profiles: DataFrame, k: int, group: str = "cell_type", rounds: int = 50) -> list[str]:
    """The k cell types that are medoids of the pseudobulk profiles (a row for each type and gene; types are few)."""
    rows = profiles.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("gene", "value"))).alias("m")).orderBy(group).collect()
    genes = sorted({g for r in rows for g in r["m"]})
    x = np.array([[r["m"].get(g, 0.0) for g in genes] for r in rows])
    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1)[None, :]))
    if k > len(rows):
        raise ValueError("more medoids than types")
    chosen = [int(d.sum(1).argmin())]
    while len(chosen) < k:  # the type that lowers the cost most
        cost = np.minimum(d[:, chosen].min(axis=1)[:, None], d).sum(axis=0)
        cost[chosen] = np.inf
        chosen.append(int(cost.argmin()))
    for _ in range(rounds):  # swap as long as it helps
        best = d[:, chosen].min(axis=1).sum()
        swaps = [(d[:, [*chosen[:i], c, *chosen[i + 1 :]]].min(axis=1).sum(), i, c) for i in range(k) for c in range(len(rows)) if c not in chosen]
        if not swaps or min(swaps)[0] >= best - 1e-12:
            break
        _, i, c = min(swaps)
        chosen[i] = c
    return sorted(rows[c][group] for c in chosen)


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a few rows, and the middle of their patches, over 255: a task holds so many images as numbers, however many its batches have."""
    edge = (PATCH - CROP) // 2
    for whole in batches:
        for at in range(0, whole.num_rows, IMAGE_SLICE):
            batch = whole.slice(at, IMAGE_SLICE)
            x = np.stack([np.frombuffer(b, dtype=np.uint8).reshape(PATCH, PATCH, 3) for b in batch.column("img").to_pylist()])
            yield batch, x[:, edge : edge + CROP, edge : edge + CROP] / 255.0


def _lists(x: np.ndarray) -> pa.Array:
    """The rows of x as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def patch_statistics(cells: DataFrame) -> DataFrame:
    """sample_id, mean and std of each colour: per-image values over the middle, averaged over images that exist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _middles(batches):
            x = x.reshape(len(x), -1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), _lists(x.mean(axis=1)), _lists(x.std(axis=1, ddof=1))], names=["sample_id", "mean", "std"])

    d = cells.select(F.col("sample_id").cast("string").alias("sample_id"), "img").filter("img is not null").mapInArrow(run, "sample_id string, mean array<double>, std array<double>")
    avg = lambda c: F.array(*[F.avg(F.col(c)[k]) for k in range(3)]).alias(c)
    return d.groupBy("sample_id").agg(avg("mean"), avg("std"))


def read_image_statistics(spark: SparkSession, path: str) -> Mapping[str, list[float]]:
    r = spark.read.json(path, schema="mean array<double>, std array<double>", multiLine=True).first()
    return json.loads(json.dumps(r.asDict()))


def normalised_patches(cells: DataFrame, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """sample_id, cell_idx, pixels: the middle of each patch as (value / 255 - mean) / std."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _middles(batches):
            x = ((x - np.asarray(mean)) / np.asarray(std)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("cell_idx"), _lists(x.reshape(len(x), -1))], names=["sample_id", "cell_idx", "pixels"])

    d = cells.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("cell_idx").cast("long").alias("cell_idx"), "img").filter("img is not null")
    return d.mapInArrow(run, "sample_id string, cell_idx long, pixels array<float>")
