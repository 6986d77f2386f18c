"""Operator 11, ranked lexical search by an Aho-Corasick scan of the documents.

There is no index of documents. The terms of all items form one automaton, whose patterns have a guard on both sides, so
that it matches whole terms only. It is broadcast, and two scans run it over the texts: the first counts documents, terms and the
documents that hold each term; the second has the term counts of each document again, turns them into scores of the
items that hold the terms, and keeps the best of each item. Texts are bytes all along: one table maps A-Z
to a-z and separators to the guard, and all other bytes, those beyond ASCII included, belong to terms.

Items come in parts of at most ITEMS items and about ITEM_BYTES of text, so the broadcast is bounded; each part is two scans.
A task keeps TOP documents for each item, and the best of items are chosen by buckets of documents before all
of an item meet.

Defined results: an item is all rows of one item_id (null is one too); items without terms have no rows; documents without
text have no terms; rows of documents with one doc_id are documents of their own, those without doc_id come
last among equal scores; empty tables give an empty result; columns other than doc_id, item_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, dropped, passes, written

TOP = 50
ITEMS, ITEM_BYTES = 20_000, 1 << 26
#: Bytes that a task passes to the automaton at once.
SCAN_BYTES = 1 << 22
#: Groups of documents in which the best of an item are chosen first.
BUCKETS = 32
_GUARD = 32
_LAST = (1 << 63) - 1


def _table() -> bytes:
    own = lambda b: b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _GUARD
    return bytes(own(b) for b in range(256))


_TABLE = _table()
_LOWER = np.frombuffer(_TABLE, np.uint8)


class Terms:
    """The automaton of some items' terms, and the items that hold each term."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        of: dict[int | None, set[bytes]] = defaultdict(set)
        for item, text in items:
            of[item] |= set((text or "").encode().translate(_TABLE).split())
        self.ids = [i for i, terms in of.items() if terms]
        self.terms = sorted(set().union(*of.values())) if of else []
        number = {t: k for k, t in enumerate(self.terms)}
        pairs = sorted((number[t], k) for k, i in enumerate(self.ids) for t in of[i])
        self.item = np.array([k for _, k in pairs], dtype=np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], dtype=np.int64), np.arange(len(self.terms) + 1))
        self.automaton = ahocorasick.Automaton()
        guard = chr(_GUARD)
        for k, t in enumerate(self.terms):
            self.automaton.add_word(guard + t.decode("latin-1") + guard, k)
        if self.terms:
            self.automaton.make_automaton()

    def counts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For stretches of documents: where they begin, their numbers of terms; and document, term, count where a term occurs."""
        raw, offsets = column_bytes(column)
        for a, b in passes(offsets, SCAN_BYTES):
            starts = offsets[a : b + 1] - offsets[a] + np.arange(1, b - a + 2)  # a guard before each text and after the last
            text = np.full(int(starts[-1]), _GUARD, np.uint8)
            place = np.ones(len(text), bool)
            place[starts - 1] = False
            text[place] = _LOWER[raw[offsets[a] : offsets[b]]]
            inside = text != _GUARD
            ends = np.flatnonzero(inside[:-1] & ~inside[1:])
            n = np.bincount(np.searchsorted(starts, ends, side="right") - 1, minlength=b - a)
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text.tobytes().decode("latin-1"))), np.int64) if self.terms else np.zeros(0, np.int64)
            doc = np.searchsorted(starts, found[::2] - 1, side="right") - 1  # a match ends on the guard after its term
            pair, tf = np.unique(doc * max(1, len(self.terms)) + found[1::2], return_counts=True)
            doc, term = np.divmod(pair, max(1, len(self.terms)))
            yield a, n, doc, term, tf


def corpus_counts(texts: DataFrame, terms: Terms) -> DataFrame:
    """term, n: documents that hold it. Term -1 has the documents with a term, -2 the number of all terms."""
    held = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        df, docs, total = np.zeros(len(t.terms), np.int64), 0, 0
        for batch in batches:
            for _, n, _, term, _ in t.counts(batch.column(0)):
                df += np.bincount(term, minlength=len(df))
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, total]))], names=["term", "n"])

    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class _Best:
    """The top rows of each item so far; rows that cannot be among them are passed over."""

    def __init__(self, items: int, top: int):
        self.top, self.least, self.rows = top, np.ones(items, np.int64), []
        self.waiting, self.most = 0, max(1 << 18, 2 * items * top)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        ok = score >= self.least[item]
        self.rows.append(tuple(x[ok] for x in (item, score, doc, null)))
        self.waiting += int(ok.sum())
        if self.waiting > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, doc, null = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = (x[order] for x in (item, score, doc, null))
        first = np.searchsorted(item, np.arange(len(self.least)))
        rank = np.arange(len(item)) - first[item]
        last = rank == self.top - 1
        self.least[item[last]] = score[last]
        kept = tuple(x[rank < self.top] for x in (item, score, doc, null))
        self.rows, self.waiting = [kept], len(kept[0])
        return kept


def _scores(docs: DataFrame, terms: Terms, n_docs: int, n_terms: int, weights: np.ndarray, top: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        best = _Best(len(t.ids), top)
        for batch in batches:
            ids = batch.column(0)
            null = np.asarray(ids.is_null()).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            for a, n, doc, term, tf in t.counts(batch.column(1)):
                ok = weights[term] > 0
                doc, term, tf = doc[ok], term[ok], tf[ok]
                m = 50 + np.array([50 * x * n_docs // n_terms for x in n.tolist()], dtype=np.int64)  # whole numbers of any size
                part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                size = t.first[term + 1] - t.first[term]
                for cut in _stretches(doc, size, len(t.ids)):
                    if not len(doc[cut]):
                        continue
                    base = doc[cut][0]
                    which = np.repeat(np.arange(cut.start, cut.stop), size[cut])
                    at = np.arange(len(which)) - np.repeat(np.cumsum(size[cut]) - size[cut], size[cut]) + t.first[term[which]]
                    total = np.zeros(int(doc[cut][-1] - base + 1) * len(t.ids), np.int64)
                    np.add.at(total, (doc[which] - base) * len(t.ids) + t.item[at], part[which])
                    hit = np.flatnonzero(total)
                    row, item = np.divmod(hit, len(t.ids))
                    row += base + a
                    best.add(item, total[hit], ids[row], null[row])
        item, score, doc, null = best.cut()
        names = pa.array(t.ids, pa.int64()).take(pa.array(item))
        yield pa.RecordBatch.from_arrays([names, pa.array(doc, mask=null.astype(bool)), pa.array(score)], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item_id long, doc_id long, score long")


def _stretches(doc: np.ndarray, size: np.ndarray, items: int) -> Iterator[slice]:
    """Slices of whole documents with some four million sums and a table of some four million scores at most, or one document."""
    a, ends = 0, np.cumsum(size)
    while a < len(doc):
        last = doc[a] + max(1, (1 << 22) // max(1, items))
        b = min(int(np.searchsorted(doc, last)), int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 22), side="right")))
        b = int(np.searchsorted(doc, doc[b])) if b < len(doc) else b
        b = max(b, int(np.searchsorted(doc, doc[a], side="right")))
        yield slice(a, b)
        a = b


def _best(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _parts(items: DataFrame) -> Iterator[list]:
    """Items in parts of bounded size; the rows of an item stay together."""
    d = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, size = d.agg(F.count_distinct("item_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-2 * n // ITEMS), -(-2 * size // ITEM_BYTES))
    for k in range(parts):
        yield d.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of each item by the weighted term counts of the contract."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for rows in _parts(items):
        terms = Terms([(r["item_id"], r["text"]) for r in rows])
        if not terms.ids:
            continue
        counted = written(corpus_counts(d.select("text"), terms), "term-counts")
        counts = {r["term"]: r["n"] for r in counted.collect()}  # a row for each term of the part
        dropped(counted)
        n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
        if not n_terms:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(k, 0) + 1))) for k in range(len(terms.terms))], dtype=np.int64)
        found = _scores(d, terms, n_docs, n_terms, weights, top)
        out = found if out is None else out.union(found)
    if out is None:
        return d.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    near = _best(out.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))), ["item_id", "bucket"], top)
    return _best(near.drop("rank"), ["item_id"], top).select("item_id", "rank", "doc_id", "score")
