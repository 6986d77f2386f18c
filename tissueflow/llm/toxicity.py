"""Operator 6, toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its hashed features (words, and word starts
of 4 to 6 bytes, which reach inflected and compounded forms); the document's is their noisy-or, 1 - prod(1 - p).
Weights are learned from document labels alone: the gradient of the noisy-or gives each sentence its share of
the blame. Sentences of 0.5 or more are the offending ones.

The model is trained on a bounded sample of labelled rows (SAMPLE of each label, texts up to SAMPLE_BYTES), so what
reaches the driver does not grow with the corpus: a text of 8 KiB has at most 4096 features of four bytes, 131 MB in all.
Scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts score 0; null labels are not learned from; without both labels all scores
are 0; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _powers, _R, _RI, byte_table, column_bytes, mix, passes

SAMPLE = 4000
SAMPLE_BYTES = 1 << 13
#: A feature and its sentence are one unsigned 32-bit number; a sampled text has a sentence in two bytes at most, so 12 bits do.
BITS = 20
STARTS = (4, 5, 6)
FEATURES = 6000
THRESHOLD = 0.7
OFFENDING = 0.5
_NOT_WORD = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_SENTENCE_END = np.array([chr(b) in ".!?\n" for b in range(256)])
_TABLE = byte_table(lower=True, seed=6)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their features (a row for each word; -1: none) and each word's sentence, numbered through all documents."""
    w = Words(raw, offsets, _NOT_WORD)
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[raw] * _powers(_R, n), out=total[1:])
    back = _powers(_RI, n + 1)[w.starts]
    shift = np.uint64(64 - BITS)
    found = np.full((len(w.starts), 1 + len(STARTS)), -1, dtype=np.int32)
    found[:, 0] = mix((total[w.ends] - total[w.starts]) * back) >> shift
    for k, size in enumerate(STARTS, 1):
        long = w.ends - w.starts > size
        at = w.starts[long]
        found[long, k] = mix((total[at + size] - total[at]) * back[long] + np.uint64(k)) >> shift
    ends = np.concatenate([[0], np.cumsum(_SENTENCE_END[raw])])
    doc = w.doc_of(np.arange(len(w.starts)))
    return w, found, ends[w.starts] + doc  # a document's border ends a sentence


def _rows(docs: DataFrame) -> DataFrame:
    """The features of each sentence of each sampled document, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            packed = []
            for a, b in passes(offsets):
                w, found, sentence = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for d in range(b - a):
                    x, y = w.first[d], w.first[d + 1]
                    nth = np.unique(sentence[x:y], return_inverse=True)[1].astype(np.uint32)
                    both = (nth[:, None] << np.uint32(BITS)) | found[x:y].astype(np.uint32)
                    packed.append(np.unique(both[found[x:y] >= 0]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["toxic", "features"])

    return docs.mapInArrow(run, "toxic int, features binary")


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list:
    """At most size labelled documents of each label, the same for the same rows."""
    known = labels.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = []
    for y in (0, 1):  # orderBy and limit keep size rows in each task
        ids += known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).collect()
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int"))
    some = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES).join(few, "doc_id")
    return [{"toxic": r["toxic"], "features": _unpacked(r["features"])} for r in _rows(some.select("toxic", "text")).collect()]


def _unpacked(packed: bytes) -> bytes:
    """Sentence and feature as two 32-bit numbers."""
    both = np.frombuffer(packed, dtype=np.uint32)
    return np.stack([both >> np.uint32(BITS), both & np.uint32((1 << BITS) - 1)], axis=1).astype(np.int32).tobytes()


def train(rows: list, steps: int = 200, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights of all 2 ** BITS features and the bias."""
    weights, bias = np.zeros(1 << BITS, dtype=np.float32), -6.0
    rows = sorted(((r["toxic"], bytes(r["features"])) for r in rows))
    y = np.array([t for t, _ in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return weights, -np.inf
    bags = [np.frombuffer(f, dtype=np.int32).reshape(-1, 2) for _, f in rows]
    seen = np.zeros((2, 1 << BITS), dtype=np.int32)
    for t, b in zip(y.astype(int), bags, strict=True):
        seen[t, np.unique(b[:, 1])] += 1
    with np.errstate(divide="ignore"):
        odds = np.log((seen[1] + 0.2) / (y.sum() + 0.4)) - np.log((seen[0] + 0.2) / ((1 - y).sum() + 0.4))
    # what speaks for label 1 in enough documents; the rest keeps weight 0
    gain = np.where((seen[1] >= 4) & (odds > 1.0), odds * seen[1], 0.0)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    chosen = chosen[gain[chosen] > 0]
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    doc, sent, feat, at = [], [], [], 0
    for d, b in enumerate(bags):
        k = place[b[:, 1]]
        b, k = b[k >= 0], k[k >= 0]
        if len(k):
            names, ids = np.unique(b[:, 0], return_inverse=True)
            doc += [d] * len(names)
            sent.append(at + ids)
            feat.append(k)
            at += len(names)
    if not at:
        return weights, -np.inf
    doc, sent, feat = np.array(doc), np.concatenate(sent), np.concatenate(feat)
    w = np.full(len(chosen), 0.5)
    square, square_b = np.full(len(w), 1e-6), 1e-6
    for _ in range(steps):
        z = np.clip(np.bincount(sent, weights=w[feat], minlength=at) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)))
        # d log P / d z of a sentence: p for label 0 against, p * clean / (1 - clean) for label 1
        share = np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)[doc] * p
        g = np.bincount(feat, weights=share[sent], minlength=len(w)) - 0.02 * w
        g_b = share.sum() - 0.02 * (bias + 6)
        square += g * g
        square_b += g_b * g_b
        w = np.maximum(0, w + rate * g / np.sqrt(square))  # evidence only ever adds: a noisy-or has no veto
        bias = min(-3.0, bias + rate * g_b / np.sqrt(square_b))
    weights[chosen] = w
    return weights, float(bias)


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score and the offending sentences (start and end in code points, score)."""
    schema = "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.append(weights.value, np.float32(0))  # the last stands for no feature
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            score, bad = [], []
            for a, b in passes(offsets):
                part = raw[offsets[a] : offsets[b]]
                w, found, sentence = features(part, offsets[a : b + 1] - offsets[a])
                own = np.zeros(b - a)
                spans: list[list] = [[] for _ in range(b - a)]
                if len(sentence) and np.isfinite(bias):
                    z = table[found].sum(axis=1, dtype=np.float64)
                    begin = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
                    z = np.add.reduceat(z, begin)
                    p = np.where(z > 0, 1 / (1 + np.exp(-np.clip(z + bias, -30, 30))), 0.0)  # no evidence at all is no score
                    doc = w.doc_of(begin)
                    own = 0.0 - np.expm1(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=b - a))
                    hits = np.flatnonzero(p >= OFFENDING)
                    if len(hits):
                        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                        last = np.append(begin[1:], len(sentence)) - 1
                        for k in hits.tolist():
                            zero = chars[offsets[a + doc[k]] - offsets[a]]
                            spans[doc[k]].append({"start": int(chars[w.starts[begin[k]]] - zero), "end": int(chars[w.ends[last[k]]] - zero), "score": float(p[k])})
                score.append(own)
                bad += spans
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(score) if score else [], pa.float64()), pa.array(bad, kind)], names=["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Train on labels(doc_id, toxic) and score docs."""
    return scored(docs, train(sample(docs, labels, size)))
