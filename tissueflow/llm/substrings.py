"""Operator 2, substring dedup by difference-cover anchors.

Windows of WINDOW words that another document with a smaller id also holds are removed. Hashing every window
would shuffle each word of the corpus. Instead, shorter runs are hashed only at places whose residue modulo a
period lies in a perfect difference set: any two residues then meet at some common shift, so two equal windows
share at least one anchor at the same offset. Only windows around anchors that two documents share are
candidates; these are hashed in full (the extension), grouped, and compared by smallest document.

Shared hashes are found by counting (which pre-aggregates hot ones) and a join back, never by gathering a group.

Defined results: a null or empty text has no words; rows without doc_id come after all others; documents of one
doc_id do not remove from each other; repeated rows get equal results; an empty table gives an empty result;
columns other than doc_id and text are ignored. Words are unchanged byte strings between separators.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, Words, column_bytes, keyed, passes, separators, windows, within, written

WINDOW = 50
# Perfect difference sets (every residue is a difference of two members, once).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}
_SEP = separators(WORD_SEPARATORS)
_SEEDS = 2, 22
_LAST = (1 << 63) - 1


def period(window: int) -> int:
    """The largest period that leaves anchors of two fifths of the window; 1 hashes every place."""
    return max([m for m in COVERS if window - m + 1 >= 0.4 * window], default=1)


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, Words]]:
    raw, offsets = column_bytes(batch.column(at))
    for a, b in passes(offsets):
        yield a, b, Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _SEP)


def anchors(keyed: DataFrame, window: int) -> DataFrame:
    """h, id, key, place of each anchor of documents that have a whole window."""
    m = period(window)
    inside = np.zeros(m, dtype=bool)
    inside[list(COVERS.get(m, (0,)))] = True
    width = window - m + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy() for k in (0, 1))
            for a, _, w in _parts(batch, 2):
                h = windows(w.hashes(_SEEDS[0]), width)
                at = np.flatnonzero(within(w.first, len(w.starts), width))
                doc = w.doc_of(at)
                place = at - w.first[doc]
                ok = inside[place % m] & (np.diff(w.first)[doc] >= window)
                at, doc, place = at[ok], doc[ok], place[ok]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[a + doc]), pa.array(keys[a + doc]), pa.array(place.astype(np.int32))], names=["h", "id", "key", "place"])

    return keyed.mapInArrow(run, "h long, id long, key long, place int")


def candidate_windows(keyed: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """h, h2, id, key, place of every whole window that holds one of the document's shared anchors."""
    m = period(window)
    joined = keyed.join(places, ["id", "key"]).select("id", "key", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy() for k in (0, 1))
            marks = batch.column(3)
            for a, b, w in _parts(batch, 2):
                h, h2 = (windows(w.hashes(s), window) for s in _SEEDS)
                change = np.zeros(len(w.starts) + 1, dtype=np.int32)
                for d in range(b - a):
                    p = np.asarray(marks[a + d].values) + w.first[d]
                    np.add.at(change, np.maximum(p - m + 1, w.first[d]), 1)
                    np.add.at(change, p + 1, -1)
                ok = (np.cumsum(change)[: len(h)] > 0) & within(w.first, len(w.starts), window)
                at = np.flatnonzero(ok)
                doc = w.doc_of(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array((h2[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[a + doc]), pa.array(keys[a + doc]), pa.array((at - w.first[doc]).astype(np.int32))],
                    names=["h", "h2", "id", "key", "place"],
                )

    return joined.mapInArrow(run, "h long, h2 int, id long, key long, place int")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, key, places: where windows begin that a document with a smaller id also holds."""
    rows = keyed(docs)
    found = anchors(rows, window)
    several = F.min("id").alias("least"), F.max("id").alias("most")
    shared = written(found.groupBy("h").agg(*several).filter("least < most").select("h"), "shared-anchors")
    places = found.join(shared, "h").groupBy("id", "key").agg(F.collect_list("place").alias("places"))
    places = written(places, "anchor-places")
    candidates = written(candidate_windows(rows, places, window), "candidate-windows")
    first = written(candidates.groupBy("h", "h2").agg(*several).filter("least < most").select("h", "h2", "least"), "first-windows")
    later = candidates.join(first, ["h", "h2"]).filter("id > least")
    return written(later.groupBy("id", "key").agg(F.collect_list("place").alias("places")), "repeated-windows")


def _covered(w: Words, d: int, places: np.ndarray, window: int) -> np.ndarray:
    n = int(w.first[d + 1] - w.first[d])
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + window, -1)
    return np.cumsum(change[:n]) > 0


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and kept_sha256 of each document."""
    d = keyed(docs).join(repeats(docs, window), ["id", "key"], "left").select("id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2)
            n_words, n_removed, kept = [], [], []
            for a, b, w in _parts(batch, 1):
                text = w.raw.tobytes()
                for k in range(b - a):
                    words = text[w.offsets[k] : w.offsets[k + 1]].split()  # on bytes: the six separators
                    places = marks[a + k]
                    gone = _covered(w, k, np.asarray(places.values), window) if places.is_valid else None
                    left = words if gone is None else [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    kept.append(b" ".join(left))
            doc_ids = [None if i == _LAST else i for i in ids]
            shas = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return d.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
