"""Operator 12, line dedup with two Bloom filters.

A key (a line, stripped and lower-cased) of at least MIN_POINTS code points that several documents hold stays only in the
document of the smallest id. The first scan sets, for each key of a document, the bits of its hash in a filter of keys seen
once; bits that a second document sets again go to the filter of keys seen twice. Filters are built in tasks, moved as
the positions of their bits and merged segment by segment, so that no key is shuffled for them. The filter of keys seen twice,
of at most 2 ** BITS bits (32 MB) whatever the corpus, is broadcast; the second scan sends only keys that it holds to an exact
confirmation by 128-bit digests, which also finds the first document. A false positive costs a row of that
shuffle and nothing else; a corpus too large for the filter tends to a plain grouping of digests, with the same results.

Documents without a suspected key never leave their scan. The others meet their list of repeated keys by a hash join
that does not sort texts. Keys in many documents (a 1000th of all suspects, so 1000 at most) are broadcast, not joined.

Defined results: a null or empty text is one empty line; rows without doc_id are one document that comes after all others, and so
are rows of one doc_id, which do not remove from each other; repeated rows get equal results; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, keyed, written

MIN_POINTS = 10
#: log2 of the bits of a filter and of one of its segments.
BITS, SEGMENT = 28, 20
#: Keys that a task gathers before it hands on their bits.
GATHERED = 1 << 20
_LAST = (1 << 63) - 1


def line_keys(text: bytes) -> list[bytes | None]:
    """The digest of each line's key, or None where the key is too short."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # on bytes: A-Z alone
        key = line.strip()  # on bytes: the six separators
        long = len(key) >= MIN_POINTS and (len(key) >= 4 * MIN_POINTS or len(key.decode()) >= MIN_POINTS)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return out


def _digests(column: pa.Array) -> Iterator[list[bytes]]:
    """The distinct digests of each text."""
    for text in column.cast(pa.large_binary()):
        yield list({k for k in line_keys(text.as_py() or b"") if k is not None})


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash; both lie in one segment."""
    segment = (h >> np.uint64(40)) % np.uint64(1 << (bits - SEGMENT)) << np.uint64(SEGMENT)
    low = np.uint64((1 << SEGMENT) - 1)
    return (segment | (h & low)).astype(np.int64), (segment | (h >> np.uint64(SEGMENT) & low)).astype(np.int64)


def _cut(bits: np.ndarray, segments: int) -> pa.Array:
    """Positions of bits by segment, a binary value of 32-bit numbers for each."""
    bits = np.unique(bits)
    at = np.searchsorted(bits, np.arange(segments + 1) << SEGMENT)
    places = (bits & ((1 << SEGMENT) - 1)).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), segments, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(places)])


def seen(texts: DataFrame, bits: int = BITS) -> DataFrame:
    """segment, once, twice: the bits that tasks set, not merged yet. texts: a column text."""
    segments = 1 << (bits - SEGMENT)

    def flushed(gathered: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(gathered), return_counts=True)
        once, twice = (_cut(np.concatenate(_bits(x, bits)), segments) for x in (h, h[n > 1]))
        out = pa.RecordBatch.from_arrays([pa.array(np.arange(segments, dtype=np.int32)), once, twice], names=["segment", "once", "twice"])
        return out.filter(pa.array(np.diff(np.frombuffer(once.buffers()[1], np.int32)) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in batches:
            for digests in _digests(batch.column(0)):
                gathered.append(_halves(digests)[:, 0])
                n += len(digests)
                if n >= GATHERED:
                    yield flushed(gathered)
                    gathered, n = [], 0
        if n:
            yield flushed(gathered)

    return texts.mapInArrow(run, "segment int, once binary, twice binary")


def twice_seen(bits_set: DataFrame) -> DataFrame:
    """segment, bits: the filter of keys seen twice, from what tasks have set; a task holds one segment at a time."""

    def packed(segment: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["segment", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(1 << SEGMENT, bool), np.zeros(1 << SEGMENT, bool)
        for batch in batches:
            for segment, one, two in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if segment != now:
                    if now is not None and twice.any():
                        yield packed(now, twice)
                    now = segment
                    once[:], twice[:] = False, False
                at = np.frombuffer(one, "<i4")
                twice[at[once[at]]] = True  # set before, by another document
                once[at] = True
                twice[np.frombuffer(two, "<i4")] = True
        if now is not None and twice.any():
            yield packed(now, twice)

    return bits_set.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, bits binary")


class Suspects:
    """The broadcast filter: tells which digests may stand in two documents."""

    def __init__(self, texts: DataFrame, bits: int = BITS):
        self.bits = bits
        held = np.zeros(1 << (bits - 3), np.uint8)
        for r in twice_seen(seen(texts, bits)).toLocalIterator():  # 2 ** (bits - SEGMENT) rows of at most 2 ** SEGMENT bits
            held[r["segment"] << (SEGMENT - 3) : (r["segment"] + 1) << (SEGMENT - 3)] = np.frombuffer(r["bits"], np.uint8)
        self.held = texts.sparkSession.sparkContext.broadcast(held)

    def of(self, digests: list[bytes]) -> np.ndarray:
        """Both halves of the digests that the filter holds."""
        h = _halves(digests)
        held, ok = self.held.value, np.ones(len(h), bool)
        for at in _bits(h[:, 0], self.bits):
            ok &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return h[ok]


def suspected(rows: DataFrame, suspects: Suspects) -> DataFrame:
    """id, key, h, h2 for each suspected key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [suspects.of(d) for d in _digests(batch.column(2))]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            h = np.concatenate([np.zeros((0, 2), "<u8"), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["id", "key", "h", "h2"])

    return rows.mapInArrow(run, "id long, key long, h long, h2 long")


def repeated_keys(found: DataFrame) -> DataFrame:
    """h, h2, least (the smallest id), n: the suspects that several documents do hold."""
    return found.groupBy("h", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).filter("least < most").drop("most")


def _later(found: DataFrame, first: DataFrame) -> DataFrame:
    """id, key, h, h2 of the keys that a document of smaller id holds; keys of very many documents are broadcast."""
    total = found.count()
    hot = F.broadcast(first.filter(F.col("n") * 1000 >= total).select("h", "h2", F.col("least").alias("hot")))  # 1000 rows at most
    marked = found.join(hot, ["h", "h2"], "left")
    few = marked.filter("hot is null").drop("hot").join(first.filter(F.col("n") * 1000 < total).select("h", "h2", "least"), ["h", "h2"])
    return few.filter("id > least").select("id", "key", "h", "h2").union(marked.filter("id > hot").select("id", "key", "h", "h2"))


#: Rows that are decided at once.
ROWS = 500
_RESULT = "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string"


def _results(ids: pa.Array, texts: pa.Array, gone: list[set[bytes]]) -> pa.RecordBatch:
    n_lines, n_dropped, kept = [], [], []
    for text, drop in zip(texts.cast(pa.large_binary()), gone, strict=True):
        text = text.as_py() or b""
        lines = text.split(b"\n")
        left = [x for x, key in zip(lines, line_keys(text), strict=True) if key not in drop] if drop else lines
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(left))
        kept.append(b"\n".join(left) if drop else text)
    shas = [hashlib.sha256(x).hexdigest() for x in kept]
    doc_ids = [None if i == _LAST else i for i in ids.to_pylist()]
    columns = [pa.array(doc_ids, pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(shas, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _clean(rows: DataFrame, suspects: Suspects) -> DataFrame:
    """The results of documents without a suspect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            part = part.filter(pa.array([not len(suspects.of(d)) for d in _digests(part.column(2))], pa.bool_()))
            yield _results(part.column(0), part.column(2), [set()] * part.num_rows)

    return rows.mapInArrow(run, _RESULT)


def _marked(rows: DataFrame, suspects: Suspects) -> DataFrame:
    """The documents with a suspect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield part.filter(pa.array([len(suspects.of(d)) > 0 for d in _digests(part.column(2))], pa.bool_()))

    return rows.mapInArrow(run, "id long, key long, text string")


def without_repeated_lines(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the lines that stay, joined by newlines) and kept_sha256 of each document."""
    rows = keyed(docs)
    suspects = Suspects(rows.select("text"), bits)
    found = written(suspected(rows, suspects), "suspected-lines")
    first = written(repeated_keys(found), "repeated-lines")
    gone = written(_later(found, first).groupBy("id", "key").agg(F.collect_set(F.struct("h", "h2")).alias("gone")), "dropped-lines")
    for table in (found, first):
        dropped(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            lists, drop = part.column(2), []
            for k in range(part.num_rows):
                h = [np.asarray(c) for c in lists[k].values.flatten()] if lists[k].is_valid else []
                drop.append({r.tobytes() for r in np.stack(h, axis=1).astype("<i8")} if h else set())
            yield _results(part.column(0), part.column(1), drop)

    marked = _marked(rows, suspects).join(gone.hint("shuffle_hash"), ["id", "key"], "left").select("id", "text", "gone")
    return marked.mapInArrow(run, _RESULT).union(_clean(rows, suspects))
