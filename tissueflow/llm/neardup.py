"""Operator 3, near-duplicates by SetSketch registers.

A document's set of word shingles is reduced to registers: exponentially spaced, truncated minima
K = floor(1 - log_b(min)), with b so near 1 that two sets share a register with probability about their Jaccard
similarity. Registers of a union are the maxima, so sketches merge.

1. Equal sets become one class (a hash of the set), whatever the number of copies.
2. Bands of registers are hashed to buckets. Each class is paired with its bucket's smallest class, the head: a star,
   whose pairs grow with the classes.
3. A pair's similarity is estimated from both registers by maximum likelihood, with the set sizes known. Pairs that come
   near the threshold are verified on full sets. Components of the verified links join most copies.
4. Buckets whose members (the head aside) still lie in several components are open. For their members a second banding takes the place
   of buckets: shingles are put in order of how many open sets hold them, rarest first, and two sets of given sizes that are
   similar enough share one of the first few of each (an exact prefix filter, by bands of the two sizes). A family of texts that stay below the
   threshold differs in its rare shingles, so its members hardly meet, however many there are.
5. Members of different components that share such a shingle are compared, in parts of at most BLOCK classes: by registers first, and then,
   from the likeliest on and while the two are not yet connected, on full sets. Pairs of one component need no look, so a
   group of n copies and a few others costs their product and not n * n. A group returns a forest of links.

Full sets travel with pairs of step 3 and with members of open groups, and with nothing else. With threshold 0.85 the bands
miss a pair at the threshold with probability under 1e-6; there is no cap on bucket sizes or partners.

Defined results: a null or empty text has no shingles and is linked with nothing; a null doc_id stands alone
(component null, kept); rows with one doc_id and different texts are different documents; repeated rows are one
class and both have its component; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, Words, column_bytes, dropped, mix, passes, separators, windows, within, written
from .graphs import components

REGISTERS = 280
BASE, RATE, LEVELS = 1.001, 20.0, (1 << 16) - 2
#: Classes of an open bucket, and their shingles, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Pairs whose likelihood is estimated at once (a hundred doubles each).
ESTIMATED = 2000
#: A class with this share of all rows is a hot one; there are at most as many.
HOT = 1000
MISS = 1e-6
#: A pair is verified if its estimate comes within this of the threshold (over four standard deviations).
MARGIN = 0.13
_SEED, _SEP = 3, separators(WORD_SEPARATORS)
_MULTIPLY = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(77)) | np.uint64(1)
_ADD = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(131))


def rows_per_band(threshold: float, registers: int = REGISTERS) -> int:
    """The most registers to a band with a miss below MISS at the threshold."""
    best = 1
    for r in range(1, registers + 1):
        if (1 - threshold**r) ** (registers // r) <= MISS:
            best = r
    return best


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, in order, and where each document's begin."""
    w = Words(raw, offsets, _SEP)
    h = w.hashes(_SEED, lower=True)
    n = np.diff(w.first)
    runs = windows(h, size)
    at = np.flatnonzero(within(w.first, len(h), size))
    doc, value = w.doc_of(at), runs[at]
    for k in range(1, size):  # shorter documents: the whole sequence
        few = np.flatnonzero(n == k)
        if len(few):
            doc = np.concatenate([doc, few])
            value = np.concatenate([value, mix(windows(h, k)[w.first[few]] + np.uint64(k))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def sketch(values: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The registers of each document; an empty set has zeros."""
    n = len(first) - 1
    least = np.full((n, registers), np.iinfo(np.uint64).max, dtype=np.uint64)
    a, b = _MULTIPLY[:registers], _ADD[:registers]
    step = 1024
    for k in range(0, len(values), step):
        some = values[k : k + step]
        here = np.searchsorted(first, [k, k + len(some) - 1], side="right") - 1
        docs = np.arange(here[0], here[1] + 1)
        docs = docs[first[docs + 1] > first[docs]]
        product = some[:, None] * a[None, :]
        product += b
        got = np.minimum.reduceat(product, np.maximum(first[docs] - k, 0), axis=0)
        least[docs] = np.minimum(least[docs], got)
    u = (least.astype(np.float64) + 1) / 2.0**64
    with np.errstate(divide="ignore"):
        x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
        k = np.floor(1 - np.log(x) / math.log(BASE))
    k = np.clip(k, 0, LEVELS + 1)
    k[np.diff(first) == 0] = 0
    return k.astype(np.uint16)


def _key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, which together tell documents apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _key(F.col("text")).alias("key"))


def digests(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, cid (16 bytes that equal sets share; null: no shingles) and registers, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            count, cid, regs = [], [], []
            for a, b in passes(offsets):
                values, first = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.diff(first)
                k = sketch(values, first)
                sums = []
                for salt in (11, 13):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(salt)))])
                    sums.append(mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)))
                both = np.stack(sums, axis=1)
                count.append(n)
                cid += [both[d].tobytes() if n[d] else None for d in range(b - a)]
                regs += [k[d].tobytes() if n[d] else None for d in range(b - a)]
            found = [pa.array(np.concatenate(count) if count else [], pa.int64()), pa.array(cid, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], names=["doc_id", "key", "n_shingles", "cid", "registers"])

    return written(_keyed(docs).mapInArrow(run, "doc_id long, key long, n_shingles long, cid binary, registers binary"), "set-digests")


def _registers(column: pa.Array) -> np.ndarray:
    """A row of registers for each of some classes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def band_hashes(k: np.ndarray, rows: int) -> np.ndarray:
    """The bucket of each band (columns) of each class (rows)."""
    bands = k.shape[1] // rows
    h = np.zeros((len(k), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    part = k[:, : bands * rows].reshape(len(k), bands, rows).astype(np.uint64)
    for j in range(rows):
        h = mix(h * np.uint64(0x100000001B3) + part[:, :, j])
    return h.view(np.int64)


def _buckets(classes: DataFrame, rows: int) -> DataFrame:
    """bucket and fid (the first 7 bytes of cid) of each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = band_hashes(_registers(batch.column(1)), rows)
                fid = np.repeat(batch.column(0).to_numpy(), h.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), pa.array(fid)], names=["bucket", "fid"])

    return classes.select("fid", "registers").mapInArrow(run, "bucket long, fid long")


def likeliest(same: np.ndarray, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity by maximum likelihood of the register comparison, given both set sizes."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    lb = math.log(BASE)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / lb
    up, down = p(u - v * j), p(v - u * j)
    stay = np.clip(1 - up - down, 1e-12, 1)
    score = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(stay)
    return np.take_along_axis(np.broadcast_to(j, score.shape), score.argmax(axis=1)[:, None], axis=1)[:, 0]


def _guesses(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """The likeliest similarity of each pair of rows of registers."""
    same, more = (x == y).sum(axis=1), (x > y).sum(axis=1)
    return likeliest(same, more, x.shape[1] - same - more, n_x.astype(float), n_y.astype(float))


def _alike(n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether two sets of these sizes can be similar enough."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a and b (cids) of the pairs (fids a and b) whose estimate comes near the threshold."""
    least = percent / 100 - MARGIN
    for c in ("a", "b"):
        own = classes.select(F.col("fid").alias(c), F.col("cid").alias(f"c{c}"), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
        pairs = pairs.join(own, c)
    pairs = pairs.filter(_alike(F.col("na"), F.col("nb"), percent)).select("ca", "cb", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ESTIMATED):
                batch = whole.slice(k, ESTIMATED)
                n_a, n_b = (batch.column(c).to_numpy() for c in (2, 3))
                ok = _guesses(_registers(batch.column(4)), _registers(batch.column(5)), n_a, n_b) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, "a binary, b binary")


#: log2 of the counters that tell how many open sets hold a shingle (those of one counter together).
COUNTERS = 20


def _size_bands() -> np.ndarray:
    """Where bands of set sizes begin: every size up to some 20, then steps of a twentieth."""
    starts = [0]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, starts[-1] * 21 // 20))
    return np.array(starts, dtype=np.int64)


_BANDS = _size_bands()


def prefix_keys(shingles: np.ndarray, counters: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of which two sets similar enough share one: of each band of partner sizes, the shingles that a partner cannot miss all, rarest first.

    And a key's side: 0 where both sizes are in one band, else the band of the set, as only sets of different sides are partners.
    """
    n = len(shingles)
    held = counters[shingles >> np.uint64(64 - COUNTERS)]
    order = np.lexsort((shingles, held))
    x, held = shingles[order], held[order]
    least, most = -(-percent * n // 100), 100 * n // percent
    own = int(np.searchsorted(_BANDS, n, side="right")) - 1
    keys, sides = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for band in range(int(np.searchsorted(_BANDS, least, side="right")) - 1, int(np.searchsorted(_BANDS, most, side="right"))):
        both = -(-percent * (n + max(least, int(_BANDS[band]))) // (100 + percent))  # shared by two such sets, at least
        first = x[: max(0, n - both + 1)][held[: max(0, n - both + 1)] > 1]  # what one set alone holds is no key
        pair = np.uint64(min(own, band) * 4096 + max(own, band))
        keys.append(mix(first + mix(np.array([pair]))))
        sides.append(np.full(len(first), 0 if band == own else own + 1, np.int32))
    return np.concatenate(keys).view(np.int64), np.concatenate(sides)


def _counters(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles of each counter stand: 2 ** COUNTERS numbers, whatever the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            held = batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - COUNTERS)
            total += np.bincount(held.astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])

    rows = sets.select("shingles").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNTERS, np.int64)
    out[rows["counter"].to_numpy()] = rows["n"].to_numpy()
    return out


def _keys_of(sets: DataFrame, percent: int) -> DataFrame:
    """bucket (a prefix key), side, cid, label and n_shingles of the open sets."""
    held = sets.sparkSession.sparkContext.broadcast(_counters(sets).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [prefix_keys(np.asarray(x.values).view(np.uint64), held.value, percent) for x in batch.column(3)]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k, _ in keys]))
            bucket, side = (np.concatenate([np.zeros(0, t), *[k[c] for k in keys]]) for c, t in enumerate((np.int64, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(side), *[batch.column(c).take(at) for c in range(3)]], names=["bucket", "side", "cid", "label", "n_shingles"])

    return sets.select("cid", "label", "n_shingles", "shingles").mapInArrow(run, "bucket long, side int, cid binary, label binary, n_shingles long")


def linked(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A forest of verified links of different components between the parts i and j of a group (within one part if they are the same)."""
    least = percent / 100 - MARGIN
    group = group.sort_values("cid", kind="stable").reset_index(drop=True)
    n, part, side, label = group["n_shingles"].to_numpy(), group["part"].to_numpy(), group["side"].to_numpy(), pd.factorize(group["label"])[0]
    k = np.frombuffer(b"".join(group["registers"]), dtype=np.uint16).reshape(len(group), -1)
    across = group["i"].iloc[0] != group["j"].iloc[0]
    xs, ys, guess = [], [], []
    for x in range(len(group) - 1):
        y = np.arange(x + 1, len(group))
        ok = (label[y] != label[x]) & ((side[y] == 0) | (side[y] != side[x])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        if across:
            ok &= part[y] != part[x]
        y = y[ok]
        if not len(y):
            continue
        y = y[(k[y] == k[x]).sum(axis=1) >= (least - 0.05) * k.shape[1]]
        for s in range(0, len(y), ESTIMATED):
            some = y[s : s + ESTIMATED]
            g = _guesses(np.broadcast_to(k[x], (len(some), k.shape[1])), k[some], np.full(len(some), n[x]), n[some])
            xs.append(np.full((g >= least).sum(), x))
            ys.append(some[g >= least])
            guess.append(g[g >= least])
    xs, ys, guess = (np.concatenate(v) if v else np.zeros(0, int) for v in (xs, ys, guess))
    root, links = list(range(label.max() + 1)), []

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    cid, sets = group["cid"].to_numpy(), [np.asarray(x).view(np.uint64) for x in group["shingles"]]  # in order as unsigned numbers
    for e in np.argsort(-guess, kind="stable").tolist():
        x, y = int(xs[e]), int(ys[e])
        p, q = find(label[x]), find(label[y])
        if p == q:
            continue
        small, large = (sets[x], sets[y]) if n[x] <= n[y] else (sets[y], sets[x])
        both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        if 100 * both >= percent * (len(small) + len(large) - both):
            root[p] = q
            links.append((cid[x], cid[y]))
    return pd.DataFrame(links, columns=["a", "b"])


def _opened(members: DataFrame) -> DataFrame:
    """bucket, main (its label of most members), and in how many parts its members and the others go, for buckets of several labels."""
    counts = members.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    counts = counts.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "label")).alias("most"))
    parts = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    return counts.filter("labels > 1").select("bucket", F.col("most.label").alias("main"), parts(F.col("most.n"), F.col("most.s")).alias("mains"), parts(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("others"))


def _open_links(docs: DataFrame, classes: DataFrame, bands: DataFrame, full: DataFrame, labels: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links of different components among members of buckets of several components, heads aside."""
    of = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("fid", "cid", "n_shingles", F.coalesce("label", "cid").alias("label"))
    members = bands.join(full.filter("n > 2"), "bucket").filter("fid <> head").select("bucket", "fid").join(of, "fid")
    wanted = members.join(_opened(members).select("bucket"), "bucket").select("cid", "label").distinct().join(classes, "cid")
    wanted = written(wanted.select("cid", "label", "n_shingles", "registers", "rep"), "open-classes")
    sets = written(_sets(docs, wanted, size).join(wanted.drop("rep"), "cid"), "open-sets")
    members = written(_keys_of(sets, percent), "open-keys")
    both = members.groupBy("bucket").agg(F.min("side").alias("s"), F.max("side").alias("t")).filter("s = 0 or s < t").select("bucket")
    d = members.select("bucket", "side", "cid").join(_opened(members.join(both, "bucket", "left_semi")), "bucket").join(sets, "cid")
    # the largest component's parts meet the others' only
    main, h = F.col("label") == F.col("main"), F.xxhash64("cid")
    d = d.withColumn("part", F.when(main, F.pmod(h, F.col("mains"))).otherwise(F.col("mains") + F.pmod(h, F.col("others"))).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.when(main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)))
    d = d.select("bucket", "side", "cid", "label", "n_shingles", "registers", "shingles", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    links = written(d.groupBy("bucket", "i", "j").applyInPandas(lambda g: linked(g, percent), "a binary, b binary"), "open-links")
    for table in (wanted, sets, members):
        dropped(table)
    return links


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cid and the full set of each class of wanted(cid, rep), from the text of its first document."""
    wanted = wanted.select("cid", "rep.doc_id", "rep.key")
    # repeated rows become one before their text is read
    d = _keyed(docs).join(wanted, ["doc_id", "key"]).groupBy("doc_id", "key", "cid").agg(F.first("text").alias("text")).select("cid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            for a, b in passes(offsets):
                values, first = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                own = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), own], names=["cid", "shingles"])

    return d.mapInArrow(run, "cid binary, shingles array<long>")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs(a, b) of classes whose full sets are similar enough."""
    pairs = likely = written(pairs.select("a", "b"), "likely-pairs")
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    sets = written(_sets(docs, classes.join(wanted, "cid"), size), "full-sets")
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"s{c}")), c)
    both = F.size(F.array_intersect("sa", "sb"))
    links = written(pairs.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
    for table in (likely, sets):
        dropped(table)
    return links


def _with_first(digest: DataFrame, of: DataFrame) -> DataFrame:
    """digest with the first document of its class's component. Classes of at least an HOT-th of all rows, HOT at most, are broadcast, so no task gets all copies of one text."""
    of = written(of, "set-components")
    least = max(1, digest.count()) / HOT
    hot = F.broadcast(of.filter(F.col("copies") >= least).select("cid", F.col("first").alias("hot")))
    d = digest.join(hot, "cid", "left")
    rest = d.filter("hot is null").drop("hot").join(of.filter(F.col("copies") < least).drop("copies"), "cid", "left")
    return d.filter("hot is not null").withColumnRenamed("hot", "first").select(rest.columns).union(rest)


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, key and n_shingles of each row, and first: doc_id and key of the first document of its group (null: no member of any)."""
    digest = digests(docs, size)
    classes = digest.filter("cid is not null and doc_id is not null").groupBy("cid").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.count("*").alias("copies"))
    fid = F.conv(F.hex(F.substring("cid", 1, 7)), 16, 10).cast("long")
    classes = written(classes.withColumn("fid", fid), "set-classes")
    bands = _buckets(classes, rows_per_band(percent / 100))
    full = written(bands.groupBy("bucket").agg(F.min("fid").alias("head"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    star = bands.join(full, "bucket").filter("fid <> head").select(F.col("fid").alias("a"), F.col("head").alias("b")).distinct()
    found = verified(docs, _likely(star, classes, percent), classes, size, percent)
    labels = components(found)
    more = _open_links(docs, classes, bands, full, labels, size, percent)
    dropped(full)
    if not more.isEmpty():
        labels = components(found.union(more))
    classes = classes.select("cid", "rep", "copies")
    joined = labels.select(F.col("node").alias("cid"), "label").join(classes, "cid")
    first = joined.groupBy("label").agg(F.min("rep").alias("first"))
    of = classes.join(joined.select("cid", "label").join(first, "label").select("cid", "first"), "cid", "left")
    of = of.select("cid", "copies", F.coalesce("first", "rep").alias("first"))
    member = F.col("doc_id").isNotNull() & F.col("cid").isNotNull()
    return _with_first(digest.drop("registers"), of).select("doc_id", "key", "n_shingles", F.when(member, F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document: links at 100 * intersection >= percent * union."""
    component = F.coalesce("first.doc_id", "doc_id")
    return grouped(docs, size, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: its first document, by doc_id and then by a hash of the text.

    Rows are told apart by doc_id and text, so a text that shares its doc_id with a copy stays. Rows alike in both are one
    document, of which the row stays whose other columns have the smallest hash; rows without doc_id are compared with
    nothing else. Columns keep their names and values, whatever they are called.
    """
    members = written(grouped(docs, size, percent), "groups")
    gone = members.filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("key") != F.col("first.key"))).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = lambda d, rows: d["doc_id"].cast("long").eqNullSafe(rows["_id"]) & (_key(d["text"]) == rows["_key"])
    out = docs.join(gone, same(docs, gone), "left_anti")
    again = written(members.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated-rows")
    if again.isEmpty():
        return out
    kinds = {f.name: f.dataType.typeName() for f in docs.schema}
    others = F.xxhash64(*[F.col(f"`{c}`") for c, kind in kinds.items() if kind not in ("map", "variant")])
    several = out.join(again, same(out, again), "left_semi")
    first = several.groupBy("doc_id", "text").agg(F.min_by(F.struct(*[several[f"`{c}`"] for c in docs.columns]), others).alias("_row"))
    return out.join(again, same(out, again), "left_anti").union(first.select("_row.*"))
